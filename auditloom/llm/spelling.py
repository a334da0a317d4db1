"""Spelling variant grouping by wildcard groups, without pairs (operator 11), in DataFrame functions only.

Words that differ by one replaced letter agree in a position and what stands before and after it. Such a
group keeps its size and its two most frequent words: each member has size - 1 near words there, and the
most frequent of them is the first of the two or, for the first itself, the second. Words that differ by one
more letter are found by looking the deletions of each word up in the vocabulary. A group has one word for
each letter at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, text_or_empty

#: Runs of letters.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, slip: int = 97) -> DataFrame:
    """Rows (word, n): the runs of letters of all texts, A-Z in lower case, with how often each is there.

    One run in slip loses a letter: that at h % length where slip divides h, the crc32 of "<id>:<run>" (a null id:
    of ":<run>"). Only words of least_chars letters and least_n places are returned. A null text has none.
    """
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(F.concat(own, F.lit(":")).alias("i"), F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(LETTERS), F.lit(0))).alias("r"))
    # a word does not get longer
    runs = runs.filter(F.length("r") >= least_chars).select("i", F.translate("r", _UPPER, _LOWER).alias("r"))
    hashed = runs.select("r", F.crc32(F.concat("i", "r").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("r")).cast("int")
    less = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    found = hashed.select(F.when(F.col("h") % slip == 0, less).otherwise(F.col("r")).alias("word"))
    return found.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def _without(word: Column, i: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))


def _ranked(word: Column, n: Column) -> Column:
    """The least of these is the most frequent word, of equal ones the first by code points."""
    return F.struct((-n).alias("m"), word.alias("w"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Rows (word, n_near, best) for the words of vocabulary (word, n) that differ from another one by one letter.

    best (m, w) is the near word w with the largest count -m.
    """
    w, n = F.col("word"), F.col("n")
    places = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    group = places.groupBy("i", F.substring("word", F.lit(1), F.col("i") - 1).alias("before"), F.substring("word", F.col("i") + 1, F.length("word")).alias("after"))
    # at most a word for each letter
    group = group.agg(F.array_sort(F.collect_list(_ranked(w, n))).alias("of")).filter(F.size("of") > 1)
    group = group.select(F.size("of").alias("size"), F.get("of", 0).alias("first"), F.get("of", 1).alias("second"), F.explode("of.w").alias("word"))
    replaced = group.select("word", (F.col("size") - 1).cast("long").alias("k"), F.when(F.col("first.w") == w, F.col("second")).otherwise(F.col("first")).alias("best"))

    shorter = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: _without(w, i)))
    deleted = vocabulary.select(_ranked(w, n).alias("long"), F.explode(shorter).alias("d"))
    found = deleted.join(vocabulary.select(F.col("word").alias("short"), F.col("n").alias("short_n")), F.col("d") == F.col("short"))
    one = F.lit(1).cast("long")
    up = found.select(F.col("short").alias("word"), one.alias("k"), F.col("long").alias("best"))
    down = found.select(F.col("long.w").alias("word"), one.alias("k"), _ranked(F.col("short"), F.col("short_n")).alias("best"))
    return replaced.unionByName(up).unionByName(down).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def variants(vocabulary: DataFrame, times: int = 2) -> DataFrame:
    """One row for each word of vocabulary (word, n): word, form, root, n, n_near, form_n.

    Two words are near if one letter is replaced, put in or left out. form is the near word of largest n, of equal
    ones the first in code-point order, if that is times n at least, else null; root is where forms lead. Forms
    grow by that factor, so chains have no more steps than n has powers of it, and rounds double the steps. An
    empty vocabulary gives an empty result.
    """
    known = cut(vocabulary.select("word", "n"))
    near = near_words(known).select(F.col("word").alias("_w"), "n_near", "best")
    out = known.join(near, F.col("word") == F.col("_w"), "left")
    takes = -F.col("best.m") >= times * F.col("n")
    out = cut(out.select("word", F.when(takes, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, -F.col("best.m")).alias("form_n")))
    # only words with a form have a root other than themselves
    roots = cut(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = cut(roots.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            break
        roots = step.select("word", "root")
    ends = roots.select(F.col("word").alias("_w"), "root")
    return out.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
), k AS (
  SELECT r, count(*) AS m, doc_id, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM r WHERE length(r) >= 5 GROUP BY r, doc_id
), h AS (
  SELECT r, m, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda p: ('0x' || x[p:p + 1])::BIGINT)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM k, crc
), v AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(m)::BIGINT AS n FROM h GROUP BY 1
), w AS (
  SELECT word, n FROM v WHERE length(word) >= 5 AND n >= 3
), p AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w
), g AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM p
), pairs AS (
  SELECT x.word, y.word AS near, y.n AS m FROM g x JOIN g y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION
  SELECT g.word, w.word, w.n FROM g JOIN w ON g.a || g.z = w.word
  UNION
  SELECT w.word, g.word, g.n FROM g JOIN w ON g.a || g.z = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM pairs GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at, form AS next FROM f
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN f ON c.next = f.word
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
