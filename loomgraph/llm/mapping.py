"""Mapping free-entered values to a canonical list: token-level repair, then soft TF-IDF over complete entries.

1. Equal values are mapped once. A value is read in parts, where semicolons separate them, and as a whole: the first reading
   that means an entry counts. It is split into tokens (case changes, signs and white space separate; remarks are dropped); run-together values and initials are tokens too.
2. Every distinct token is joined to the vocabulary of the reference list (words of terms and glosses, terms run together,
   initials) by edit distance: both sides emit their deletion neighbourhoods, equal neighbours meet, and the pairs are
   verified by restricted edit distance (with transpositions). Abbreviations join by their prefixes.
3. The corrected tokens of a value are weighed against each complete entry by soft TF-IDF: rarity in the reference list times
   likeness. The best entry is taken if it explains enough of the value; otherwise the value is unmatched (term_id 0).

The reference list and what is derived from it is fixed and small (its size is checked); nothing that grows with the values
is broadcast, and a value that fills a third of all rows is one row until the last join, where it is joined by broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.canonical import is_blank
from loomgraph.runtime import HOT_SHARE, cut, hot_keys, read, skew_join

#: Entries that the reference list may have at most: its tables are broadcast.
MOST_ENTRIES = 20_000
#: Least share of the value's weight that an entry must explain, and least share of the entry that must be named.
EXPLAINED, NAMED = 0.62, 0.2
#: Likeness of an abbreviation to its word.
ABBREVIATED = 0.85
#: Remarks around a value, in order: bracketed notes, numbering, prefixes, hedges.
REMARKS = [r"\([^)]*\)", r"^\s*\d+\s*[).:]\s+", r"^\s*[a-z]{2,4}:\s*", r"\b(probably|mainly|mostly|likely|possibly|perhaps|maybe|roughly|approx|cf|e\.g\.|i\.e\.)(?![a-z])"]


def plain(c: Column) -> Column:
    """Lower-case words of the value, separated by single spaces, without remarks; of a remark alone, its words."""
    split = F.regexp_replace(c, r"(?<=[\p{Ll}])(?=\p{Lu})", " ")
    low = F.lower(split)
    bare = low
    for r in REMARKS:
        bare = F.regexp_replace(bare, r, " ")
    words = lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))
    return F.when(words(bare) == "", words(low)).otherwise(words(bare))


def readings(c: Column) -> Column:
    """What of a value is mapped, in order of preference: each part between semicolons, then the whole."""
    parts = F.transform(F.split(c, ";"), plain)
    return F.array_distinct(F.filter(F.concat(parts, F.array(plain(c))), lambda x: x != ""))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def vocabulary(terms: list[tuple[int, str, str, str]]) -> tuple[list[tuple], dict[str, dict]]:
    """canon_terms rows -> (rows (field, word, kind, entry, term_id, weight, total), per field the weights of unknown words).

    entry: a term or its gloss, each a complete entry. kind 'word', or 'whole' for a term run together or its initials.
    """
    rows, unknown = [], {}
    for field in sorted({t[1] for t in terms}):
        entries = []
        for term_id, f, term, gloss in terms:
            if f == field:
                entries.append((f"t{term_id}", term_id, _words(term or "")))
                if gloss:
                    entries.append((f"g{term_id}", term_id, _words(gloss)))
        df: dict[str, int] = {}
        for _, _, ws in entries:
            for w in set(ws):
                df[w] = df.get(w, 0) + 1
        idf = {w: math.log(1 + len(entries) / n) * (0.5 if len(w) <= 2 else 1.0) for w, n in df.items()}
        unknown[field] = {"long": math.log(1 + len(entries)), "short": min(idf.values(), default=0.1)}
        for entry, term_id, ws in entries:
            total = sum(idf[w] for w in set(ws))
            rows += [(field, w, "word", entry, term_id, idf[w], total) for w in sorted(set(ws))]
            if entry.startswith("t"):
                rows.append((field, "".join(ws), "whole", entry, term_id, total, total))
                for kept in {tuple(ws), tuple(w for w in ws if len(w) > 3)}:
                    initials = "".join(w[0] for w in kept)
                    if len(initials) >= 3 and initials not in df:
                        rows.append((field, initials, "initials", entry, term_id, total, total))
            elif len(ws) > 1:
                rows.append((field, "".join(ws), "whole", entry, term_id, total, total))
    return rows, unknown


def edits_allowed(n: Column) -> Column:
    """Edits by which a vocabulary word of n letters may differ: none up to one letter, one up to five, else two."""
    return F.when(n <= 1, 0).when(n <= 5, 1).otherwise(2)


def deletions(c: Column, most: Column) -> Column:
    """All strings that c gives by up to `most` (0, 1, 2) deletions, c included, without repeats."""
    one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    safe = F.when(F.length(c) > 0, one(c)).otherwise(F.array(c))
    two = F.flatten(F.transform(safe, lambda s: F.when(F.length(s) > 0, one(s)).otherwise(F.array(s))))
    return F.array_distinct(F.when(most == 0, F.array(c)).when(most == 1, F.concat(F.array(c), safe)).otherwise(F.concat(F.array(c), safe, two)))


def edit_distance(a: str, b: str, most: int) -> int:
    """Restricted Damerau-Levenshtein distance, or most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def repaired(tokens: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """Distinct tokens(field, token) joined to words(field, word, kind), of `longest` letters at most, -> (field, token, word, kind, like)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for field, token, word, kind in zip(*(b.column(c).to_pylist() for c in ("field", "token", "word", "kind"))):
                allowed = 0 if len(word) <= 1 or kind == "initials" else 1 if len(word) <= 5 else 2
                d = edit_distance(token, word, allowed)
                if d <= allowed and (len(word) > 2 or d == 0 or sorted(token) == sorted(word)):
                    out.append((field, token, word, kind, 1.0 - d / max(len(word), len(token)) if d else 1.0))
            cols = list(zip(*out)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:4]] + [pa.array(cols[4], pa.float64())], ["field", "token", "word", "kind", "like"])

    # a token that is longer than any word by more than its edits is like none
    near_t = tokens.filter(F.length("token") <= longest + 2).select("field", "token", F.explode(deletions(F.col("token"), edits_allowed(F.length("token")))).alias("near"))
    near_w = words.select("field", "word", "kind", F.explode(deletions(F.col("word"), F.when(F.col("kind") == "initials", 0).otherwise(edits_allowed(F.length("word"))))).alias("near"))
    pairs = near_t.join(F.broadcast(near_w), ["field", "near"]).select("field", "token", "word", "kind").distinct()
    edited = pairs.mapInArrow(verify, "field string, token string, word string, kind string, like double")
    stems = words.filter("kind = 'word' and length(word) > 3").select("field", "word", F.explode(F.sequence(F.lit(3), F.length("word") - 1)).alias("n")).select("field", "word", F.substring("word", F.lit(1), F.col("n")).alias("token"))
    cut_off = tokens.join(F.broadcast(stems), ["field", "token"]).select("field", "token", "word", F.lit("word").alias("kind"), F.lit(ABBREVIATED).alias("like"))
    plural = words.filter("kind = 'word' and length(word) > 4").select("field", "word", F.concat("word", F.lit("s")).alias("token"))
    plurals = tokens.join(F.broadcast(plural), ["field", "token"]).select("field", "token", "word", F.lit("word").alias("kind"), F.lit(0.97).alias("like"))
    return edited.unionByName(cut_off).unionByName(plurals)


def map_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """values(field, row_id, value), terms(term_id, field, term, gloss) -> (field, row_id, value, term_id), one row per value
    row that is not blank and not written exactly as a term of its field; term_id 0 where no entry is meant.

    Ties between entries go to the one named more fully, then to the smaller term_id. A field without entries maps to 0.
    """
    spark = values.sparkSession
    reference = [tuple(r) for r in terms.select("term_id", "field", "term", "gloss").filter("field is not null").limit(MOST_ENTRIES + 1).collect()]
    if len(reference) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} reference entries")
    rows, unknown = vocabulary(reference)
    exact = spark.createDataFrame([(r[1], r[2]) for r in reference], "field string, value string").distinct()
    asked = values.filter(~is_blank(F.col("value")) & F.col("field").isNotNull()).join(F.broadcast(exact), ["field", "value"], "left_anti")
    vocab = spark.createDataFrame(rows, "field string, word string, kind string, entry string, term_id int, weight double, total double")
    words = vocab.select("field", "word", "kind").distinct()
    longest = max((len(r[1]) for r in rows), default=0)
    distinct = asked.select("field", "value").distinct()
    texts = cut(distinct.select("field", "value", F.posexplode_outer(readings(F.col("value"))).alias("rank", "plain")).fillna("", ["plain"]).fillna(0, ["rank"]))
    split = texts.select("field", "plain").distinct().select("field", "plain", F.array_distinct(F.filter(F.split("plain", " "), lambda w: w != "")).alias("words"))
    whole = F.regexp_replace("plain", " ", "")
    wholes = F.when((F.size("words") > 1) & (F.length(whole) <= longest), F.array(whole)).otherwise(F.array())
    said = split.select("field", "plain", "words", F.concat(F.transform("words", lambda w: F.struct(w.alias("token"), F.lit(False).alias("joined"))), F.transform(wholes, lambda w: F.struct(w.alias("token"), F.lit(True).alias("joined")))).alias("all"))
    said = cut(said.select("field", "plain", F.inline("all")))
    # tokens of several words run together only meet whole terms and initials, exactly; single tokens meet everything by edit distance
    tokens = said.filter("not joined").select("field", "token").distinct()
    fixed = repaired(tokens, words, longest).groupBy("field", "token", "word", "kind").agg(F.max("like").alias("like"))
    meant = fixed.join(F.broadcast(vocab), ["field", "word", "kind"]).groupBy("field", "token", "entry", "term_id", "total").agg(F.max(F.struct("like", "weight", "kind")).alias("b"))
    per_token = cut(meant.groupBy("field", "token").agg(F.collect_list(F.struct("entry", "term_id", "total", "b.like", "b.weight", "b.kind")).alias("found")))
    joined = said.filter("joined").join(F.broadcast(vocab.filter("kind <> 'word'").withColumnRenamed("word", "token")), ["field", "token"]).select("field", "plain", "entry", "term_id", "total", "kind")
    weights = spark.createDataFrame([(f, u["long"], u["short"]) for f, u in unknown.items()], "field string, long double, short double")
    single = said.filter("not joined").join(F.broadcast(weights), "field", "left")
    key = F.concat_ws("\u0001", "field", "token")
    keyed = single.withColumn("k", key)
    found = skew_join(keyed, per_token.withColumn("k", key).select("k", "found"), "k", hot_keys(keyed, "k"), "left")
    best_weight = F.aggregate(F.coalesce("found", F.array().cast("array<struct<entry:string,term_id:int,total:double,like:double,weight:double,kind:string>>")), F.lit(0.0), lambda a, e: F.greatest(a, F.when(e["kind"] == "word", e["weight"]).otherwise(F.col("long"))))
    own = F.when(F.size(F.coalesce("found", F.array())) > 0, best_weight).when((F.length("token") <= 2) | F.col("token").rlike("^[0-9]+$"), F.col("short")).otherwise(F.col("long"))
    weighed = found.select("field", "plain", "token", own.alias("own"), "found")
    values_weight = weighed.groupBy("field", "plain").agg(F.sum("own").alias("all"), F.count("*").alias("n"))
    hits = weighed.select("field", "plain", "own", F.inline("found"))
    scored = hits.groupBy("field", "plain", "entry", "term_id", "total").agg(F.sum(F.col("own") * F.col("like")).alias("explained"), F.sum(F.col("weight") * F.col("like")).alias("named"), F.max(F.when(F.col("kind") != "word", F.col("like")).otherwise(0.0)).alias("whole"))
    scored = scored.join(values_weight, ["field", "plain"])
    share, named = F.col("explained") / F.col("all"), F.least(F.lit(1.0), F.col("named") / F.col("total"))
    is_whole = (F.col("whole") > 0) & (F.col("n") == 1)
    good = is_whole | ((share >= EXPLAINED) & (named >= NAMED))
    score = F.when(is_whole, 1.0 + F.col("whole")).otherwise(share * F.sqrt(named + 0.25))
    candidates = scored.filter(good).select("field", "plain", score.alias("score"), "term_id").unionByName(joined.select("field", "plain", F.lit(2.0).alias("score"), "term_id"))
    chosen = candidates.groupBy("field", "plain").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("term_id")).alias("t"))).alias("m")).select("field", "plain", (-F.col("m.t")).alias("term_id"))
    chosen = cut(chosen)
    # what is left may be a term with its breaks misplaced: run together, it meets the terms run together by edit distance
    rest = split.join(chosen, ["field", "plain"], "left_anti").select("field", "plain", whole.alias("token")).filter("token <> ''")
    ends = words.filter("kind = 'whole' and length(word) > 5")
    late = repaired(rest.select("field", "token").distinct(), ends, longest).join(F.broadcast(vocab), ["field", "word", "kind"]).groupBy("field", "token").agg(F.max(F.struct("like", (-F.col("term_id")).alias("t"))).alias("m"))
    late = rest.join(late, ["field", "token"]).select("field", "plain", (-F.col("m.t")).alias("term_id"))
    chosen = chosen.unionByName(late)
    first = texts.join(chosen, ["field", "plain"], "left").groupBy("field", "value").agg(F.min(F.when(F.col("term_id").isNotNull(), F.struct("rank", "term_id"))).alias("m"))
    mapped = first.select(F.concat_ws("\u0001", "field", "value").alias("k"), F.coalesce("m.term_id", F.lit(0)).cast("int").alias("term_id"))
    final = asked.withColumn("k", F.concat_ws("\u0001", "field", "value"))
    return skew_join(final, mapped, "k", hot_keys(final, "k", HOT_SHARE)).select("field", "row_id", "value", "term_id")


def free_values(spark: SparkSession, d: str) -> DataFrame:
    """(field, row_id, value) of the three free-entered fields."""
    fields = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("bottleneck_class", "mathematical_structure")]
    e = read(spark, d, "entities").select(F.col("entity_id").alias("row_id"), F.inline(F.array(*fields)))
    r = read(spark, d, "relations").select(F.col("relation_id").alias("row_id"), F.lit("relation").alias("field"), F.col("relation").alias("value"))
    return e.filter("value is not null").unionByName(r.filter("value is not null").select(*e.columns))


def p5_mapped(spark: SparkSession, d: str) -> DataFrame:
    return map_values(free_values(spark, d), read(spark, d, "canon_terms"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(field, row_id, term_id) of every free-entered value."""
    return p5_mapped(spark, d).select("field", "row_id", "term_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no entry, with their number of rows."""
    return p5_mapped(spark, d).filter("term_id = 0").groupBy("field", "value").agg(F.count("*").alias("rows"))


QUERIES = {"p5_found": p5_found, "p5_unmatched": p5_unmatched}
SQL: dict[str, str] = {}
