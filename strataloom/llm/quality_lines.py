"""Line-first cleaning, in DataFrame functions only.

Every line is judged by rules of three kinds. Navigation: cells joined by bars or arrows, or a run of three or more
short lines (at most SHORT words) without closing punctuation, such as a menu with a link a line. Boilerplate: page
phrases (cookie notices, newsletters, copyright years, page numbers), bare addresses, symbol noise (symbols are as many
as the words) and shouting (half of the words end in two exclamation marks). Punctuation: a line of FRAGMENT words or
more without closing punctuation in any of several scripts fails, unless the next line shows it to be wrapped prose
(that starts with a letter that is no capital, or this line is a long one that such a line or a closed one goes on
from) or a heading of a closed line of HEADED words or more. Failing lines are removed; a document that loses over
`max_loss` percent of its words is rejected.

Contract. Null text has no words. `base_failed` and the counts follow the words of the whole text; `kept` is false
where it is true. Repeated three-word windows are matched by 64-bit hashes. Blank lines are no lines. Repeated rows
give repeated results. Extra columns pass through; columns with an output's name give way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import table

SYMBOLS = "#*$%&|<>"
BARS = "|»›·→"
CLOSING = ".!?…:;\"'”“’»«)]>。！？；：」』）》】｡।॥۔؟"
#: Page phrases of the lower-cased line, each with texts one of which it must hold. `contains` compares wherever the first
#: byte fits, so most begin with a rare letter.
PHRASES = {
    r"cookie (policy|notice|settings|preferences)": ["kie policy", "kie notice", "kie settings", "kie preferences"],
    r"accept (all )?cookies": ["kies"],
    r"privacy policy": ["vacy policy"],
    r"terms of (use|service)": ["ms of use", "ms of service"],
    r"terms and conditions": ["ms and conditions"],
    r"all rights reserved": ["ghts reserved"],
    r"enable javascript": ["javascript"],
    r"click here": ["k here"],
    r"read more": ["read more"],
    r"(sign up for|subscribe to) (our|the) newsletter": ["wsletter"],
    r"lorem ipsum": ["psum"],
    r"powered by": ["powered by"],
    r"back to top": ["k to top"],
    r"skip to (main )?content": ["kip to "],
    r"share (this|on (facebook|twitter))": ["share this", "share on "],
    r"add to cart": ["cart"],
    r"copyright [0-9]{4}": ["pyright "],
    r"page [0-9]+ of [0-9]+": ["page "],
    r"last (updated|modified)": ["pdated", "modified"],
}
#: Looked for in the lower-cased line.
BOILERPLATE = (
    rf"\b({'|'.join(PHRASES)})\b"
    r"|(\(c\)|©) ?[0-9]{4}|^[\x20\x09]*https?://[^\x20\x09]+[\x20\x09\x0d]*$"
)
#: A lower-cased text without any of these holds no boilerplate line.
TELLING = [*(t for texts in PHRASES.values() for t in texts), "(c)", "©", "http"]
SHORT, FRAGMENT, HEADING, HEADED, LONG = 4, 3, 10, 8, 40
MAX_LOSS = 50


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _has(line: Column, parts: str | list[str]) -> Column:
    found = line.contains(parts[0])
    for part in parts[1:]:
        found = found | line.contains(part)
    return found


def seen(text: Column, lower: Column) -> Column:
    """What a whole text may hold; its lines are not searched for the rest."""
    measures = {"bars": _has(text, BARS), "shouts": text.contains("!!"), "symbols": _has(text, SYMBOLS), "boilerplate": _has(lower, TELLING)}
    return F.struct(*[m.alias(name) for name, m in measures.items()])


def marks(line: Column, words: Column, held: Column) -> Column:
    """What is known of a line with words by itself, `held` being `seen` of its text; each measure is taken once, here."""
    bars = F.when(held["bars"] & _has(line, BARS), F.regexp_count(line, F.lit(rf"(?:^|[\x20\x09])(?:{'|'.join(map(re.escape, BARS))})(?=[\x20\x09]|$)"))).otherwise(0)
    shouts = F.when(held["shouts"] & line.contains("!!"), F.regexp_count(line, F.lit(r"!!(?=[\x20\x09-\x0D]|$)"))).otherwise(0)
    symbols = F.when(held["symbols"] & _has(line, SYMBOLS), _without(line, SYMBOLS)).otherwise(0)
    closed = F.instr(F.lit(CLOSING), F.right(F.element_at(words, -1), F.lit(1))) > 0
    goes_on = F.get(words, 0).rlike(r"^[\p{Ll}\p{Lo}]")
    measures = {"n": F.size(words).cast("long"), "bars": bars, "shouts": shouts, "symbols": symbols, "closed": closed, "goes_on": goes_on, "long": F.length(line) >= LONG, "boilerplate": held["boilerplate"] & F.lower(line).rlike(BOILERPLATE)}
    return F.struct(*[m.alias(name) for name, m in measures.items()])


def judged(marked: str) -> Column:
    """Each line of the array column `marked` as (n, fails), fails: it is to go."""

    def judge(x: Column, i: Column) -> Column:
        at = lambda k: F.get(F.col(marked), i + k)
        short = lambda y: F.coalesce(~y["closed"] & (y["n"] <= SHORT), F.lit(False))
        before, after = short(at(-1)), short(at(1))
        menu = short(x) & ((before & after) | (after & short(at(2))) | (before & short(at(-2))))
        wrapped = F.coalesce(at(1)["goes_on"] | (x["long"] & ((x["goes_on"] & at(1).isNotNull()) | at(1)["closed"])), F.lit(False))
        heading = F.coalesce((x["n"] <= HEADING) & at(1)["closed"] & (at(1)["n"] >= HEADED), F.lit(False))
        alone = ((x["bars"] >= 3) & (3 * x["bars"] >= x["n"])) | ((x["shouts"] >= 3) & (2 * x["shouts"] >= x["n"])) | (x["symbols"] >= x["n"]) | x["boilerplate"]
        fails = alone | menu | (~x["closed"] & (x["n"] >= FRAGMENT) & ~wrapped & ~heading)
        return F.struct(x["n"].alias("n"), fails.alias("fails"))

    return F.transform(F.col(marked), judge)


def line_quality(docs: DataFrame, max_loss: int = MAX_LOSS) -> DataFrame:
    """`docs` with the base counts, clean_text, n_clean_words, base_failed and kept added."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_clean_words", "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.array_remove(F.split(x, r"[\x20\x09-\x0D]+"), "").alias("words")))
    rows = docs.withColumns({"_cut": F.filter(cut, lambda x: F.size(x["words"]) > 0), "_lower": F.lower(text)})
    rows = rows.withColumns({"_words": F.flatten("_cut.words"), "_lines": F.col("_cut.line"), "_seen": seen(text, F.col("_lower"))})
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.when(F.col("_seen.symbols"), _without(text, SYMBOLS)).otherwise(0).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_marks": F.transform("_cut", lambda x: marks(x["line"], x["words"], F.col("_seen"))),
    })
    rows = rows.withColumn("_judged", judged("_marks"))
    # words in three-word windows that occur twice or more; each step is a column of its own, computed once a row
    windows = F.transform(F.sequence(F.lit(1), F.size("_words") - 2), lambda i: F.xxhash64(F.get("_words", i - 1), F.get("_words", i), F.get("_words", i + 1)))
    rows = rows.withColumn("_windows", F.when(F.col("n_words") >= 3, windows))
    several = F.size("_windows") > F.size(F.array_distinct("_windows"))
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_ordered", F.when(several, ordered))
    twice = F.filter("_ordered", lambda x, i: (x["h"] == F.get("_ordered", i - 1)["h"]) | (x["h"] == F.get("_ordered", i + 1)["h"]))
    rows = rows.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a window adds three words, or as many as it lies behind the marked window before it
    covered = F.transform("_at", lambda i, k: F.least(F.lit(3), i - F.coalesce(F.get("_at", k - 1), F.lit(-3))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    rows = rows.withColumns({
        "clean_text": F.array_join(F.filter("_lines", lambda x, i: ~F.get("_judged", i)["fails"]), "\n"),
        "n_clean_words": F.aggregate("_judged", F.lit(0).cast("long"), lambda a, x: a + F.when(~x["fails"], x["n"]).otherwise(0)),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (100 * (F.col("n_words") - F.col("n_clean_words")) <= max_loss * F.col("n_words"))
    return rows.withColumns({"base_failed": failed, "kept": kept}).drop("_cut", "_lower", "_words", "_lines", "_seen", "_marks", "_judged", "_windows", "_ordered", "_at")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line-first verdict of every document."""
    found = line_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_clean_words", "kept")


_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CLOSING, _BARS = CLOSING.replace("'", "''"), "|".join(map(re.escape, BARS))
OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_SPLIT} AS w FROM documents
), l AS (
  SELECT rid, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT rid, string_split(text, chr(10)) AS s FROM d)
), j AS (
  SELECT rid, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(regexp_replace(' ' || line || ' ', '[\x20\x09]', '  ', 'g'), '[\x20\x09]({_BARS})[\x20\x09]')) AS bars,
         len(regexp_extract_all(regexp_replace(line || ' ', '[\x20\x09-\x0D]', '  ', 'g'), '!![\x20]')) AS shouts,
         length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols,
         contains('{_CLOSING}', right(rtrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 1)) AS closed,
         regexp_matches(line, '^[\x20\x09-\x0D]*[\p{{Ll}}\p{{Lo}}]') AS goes_on, length(line) >= {LONG} AS long
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), k AS (
  SELECT *, NOT closed AND n <= {SHORT} AS short,
         (bars >= 3 AND 3 * bars >= n) OR symbols >= n OR (shouts >= 3 AND 2 * shouts >= n) OR regexp_matches(lower(line), '{BOILERPLATE}') AS alone
  FROM j
), c AS (
  SELECT *, coalesce(lag(short) OVER o, false) AS b1, coalesce(lag(short, 2) OVER o, false) AS b2, coalesce(lead(short) OVER o, false) AS a1, coalesce(lead(short, 2) OVER o, false) AS a2,
         coalesce(lead(goes_on) OVER o, false) AS next_goes_on, coalesce(lead(closed) OVER o, false) AS next_closed, coalesce(lead(n) OVER o, 0) AS next_n
  FROM k WINDOW o AS (PARTITION BY rid ORDER BY pos)
), v AS (
  SELECT *, alone OR (short AND ((b1 AND a1) OR (a1 AND a2) OR (b1 AND b2)))
      OR (NOT closed AND n >= {FRAGMENT} AND NOT (next_goes_on OR (long AND (next_closed OR (goes_on AND next_n > 0)))) AND NOT (n <= {HEADING} AND next_closed AND next_n >= {HEADED})) AS fails
  FROM c
), s AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (NOT fails), 0) AS n_clean_words FROM v GROUP BY rid
), g AS (
  SELECT rid, i, (w[i], w[i + 1], w[i + 2]) AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM g) WHERE c > 1
), m AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_clean_words, 0) AS BIGINT) AS n_clean_words
  FROM d LEFT JOIN s USING (rid) LEFT JOIN m USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_clean_words) <= {MAX_LOSS} * n_words AS kept
FROM f
"""
