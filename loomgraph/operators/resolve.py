"""Entity resolution: name normalisation, similarity, blocking, confidence, decisions and their evaluation."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.graph import NODE_TYPES, as_label, sql_label, sql_values
from loomgraph.runtime import cut, read

LINK, MERGE, BLOCK = 0.85, 0.95, 0.6
#: Similarities from which the most alike pairs are looked for.
NEAR = (0.95, 0.8)
#: Most tokens of a name that meets others by sets of tokens; most letters of one whose parts are looked up; letters of a mark of
#: longer ones; bits of the table of names (64 a row); names of one mark that meet the others in a task; spellings of a form in a row.
SETS, LETTERS, GRAM, BITS, CROWD, SPELLINGS = 8, 64, 3, 1 << 24, 500, 50
#: Separators between tokens of a name.
SEPARATORS = r"[\s\-_/]+"
# Canonical names and their aliases.
ALIASES = {
    "transformer": ["transformer architecture", "transformer model"],
    "bert": ["bidirectional encoder representations from transformers"],
    "gpt": ["generative pre-trained transformer"],
    "vae": ["variational autoencoder", "variational auto-encoder"],
    "gan": ["generative adversarial network", "generative adversarial net"],
    "resnet": ["residual network", "deep residual network", "residual net"],
    "lstm": ["long short-term memory"],
    "gru": ["gated recurrent unit"],
    "cnn": ["convolutional neural network"],
    "rnn": ["recurrent neural network"],
    "mlp": ["multi-layer perceptron", "multilayer perceptron"],
    "relu": ["rectified linear unit"],
    "adam": ["adam optimizer"],
    "sgd": ["stochastic gradient descent"],
    "dropout": ["dropout regularization"],
    "batchnorm": ["batch normalization", "batch norm"],
    "layernorm": ["layer normalization", "layer norm"],
    "attention": ["attention mechanism"],
    "self-attention": ["self attention", "scaled dot-product attention"],
    "clip": ["contrastive language-image pre-training"],
    "vit": ["vision transformer"],
    "lora": ["low-rank adaptation"],
    "rlhf": ["reinforcement learning from human feedback"],
    "dpo": ["direct preference optimization"],
    "ppo": ["proximal policy optimization"],
    "moe": ["mixture of experts"],
    "rag": ["retrieval augmented generation", "retrieval-augmented generation"],
    "flash attention": ["flashattention", "flash-attention"],
    "diffusion model": ["diffusion models", "denoising diffusion"],
    "ddpm": ["denoising diffusion probabilistic model"],
    "knowledge distillation": ["model distillation", "distillation"],
    "fine-tuning": ["finetuning", "fine tuning"],
    "quantization": ["model quantization", "weight quantization"],
}


def alias_dim(spark: SparkSession, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    rows = {a: c for c, xs in aliases.items() for a in xs} | {c: c for c in aliases}
    return spark.createDataFrame(sorted(rows.items()), "alias string, canonical string")


def stripped(c: Column) -> Column:
    """Lower case, without white space of any kind at the ends."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def normalized(df: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """Adds `out`: lower case, trimmed, aliases replaced by their canonical name; and `out`_known: whether the name is in the table."""
    low = df.withColumn("alias", stripped(F.col(column)))
    j = low.join(F.broadcast(aliases), "alias", "left")
    return j.withColumn(out, F.coalesce("canonical", "alias")).withColumn(f"{out}_known", F.col("canonical").isNotNull()).drop("alias", "canonical")


def string_similarity(a: Column, b: Column) -> Column:
    """1 if equal; else the larger of the tokens' Jaccard index and the share of the longer name that the shorter one is in."""
    ta, tb = (F.array_distinct(F.split(x, SEPARATORS)) for x in (a, b))
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    la, lb = F.length(a), F.length(b)
    inside = F.when(F.greatest(la, lb) == 0, 0.0).when(F.contains(a, b) | F.contains(b, a), F.least(la, lb) / F.greatest(la, lb)).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(jaccard, inside))


def pair_confidence(string_sim: Column, alias_match: Column, embedding: Column | None = None, judged: Column | None = None) -> Column:
    """Weighted signals over the weights present: string .4, alias .2, embedding .3, judge .1; what is absent goes to string."""
    has_e = embedding.isNotNull() if embedding is not None else F.lit(False)
    has_j = judged.isNotNull() if judged is not None else F.lit(False)
    e = F.coalesce(embedding, F.lit(0.0)) if embedding is not None else F.lit(0.0)
    j = F.coalesce(judged.cast("double"), F.lit(0.0)) if judged is not None else F.lit(0.0)
    ws = F.when(has_e, 0.4).otherwise(0.6) + F.when(has_j, 0.0).otherwise(0.1)
    we, wj = F.when(has_e, 0.3).otherwise(0.0), F.when(has_j, 0.1).otherwise(0.0)
    return (string_sim * ws + alias_match.cast("double") * 0.2 + e * we + j * wj) / (ws + 0.2 + we + wj)


def subsets_dim(spark: SparkSession, most: float) -> DataFrame:
    """(n, m, places): for sets of n tokens that are to meet sets of m, each choice of as many of the n places as both must have
    in common. For n and m up to SETS only."""
    common = lambda n, m: math.ceil((n + m) * (most / (1 + most)) - 1e-9)
    near = [(n, m) for n in range(1, SETS + 1) for m in range(1, SETS + 1) if common(n, m) <= min(n, m)]
    return spark.createDataFrame([(n, m, list(c)) for n, m in near for c in combinations(range(n), common(n, m))], "n int, m int, places array<int>")


def tokens(norm: str) -> Column:
    return F.array_sort(F.array_distinct(F.split(norm, SEPARATORS)))


def alike_tokens(names: DataFrame, most: float) -> DataFrame:
    """names(node_type, norm, ts, ...) -> pairs of rows x, y (without ts), in either order, whose token sets `ts` are alike by `most`.

    Sets of n and m need `o` tokens in common. Up to SETS tokens they meet by all choices of o tokens, so what meets is alike; of
    the choices that two have in common the first one counts. A choice of many names ("collapse of ... codes") is met in parts. Longer ones meet by the n - o + 1 rarest tokens, in one fixed
    order, of which either holds a common one; by both sizes.
    """
    bare = names.drop("ts")
    sized = names.select(F.struct(*bare.columns).alias("x"), "node_type", "norm", "ts", F.size("ts").alias("n"))
    chosen = sized.join(F.broadcast(subsets_dim(names.sparkSession, most)), "n")
    few = chosen.select("x", "node_type", "n", "m", "ts", F.transform("places", lambda i: F.col("ts")[i]).alias("chosen"))
    few = few.select("x", "node_type", "n", "m", F.array_join("chosen", " ").alias("mark"), F.struct(F.size("chosen").alias("o"), F.array_except("ts", "chosen").alias("rest")).alias("left"))

    each = sized.filter(F.col("n") > int(SETS * most)).select("node_type", "norm", "n", F.explode("ts").alias("mark"))
    rarity = each.groupBy("node_type", "mark").agg(F.count("*").alias("df"))
    many = each.join(rarity, ["node_type", "mark"]).groupBy("node_type", "norm", "n").agg(F.array_sort(F.collect_set(F.struct("df", "mark"))).alias("ms"))
    many = many.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * most - 1e-9).cast("int"), F.floor(F.col("n") / most + 1e-9).cast("int")))).filter(F.greatest("n", "m") > SETS)
    common = F.ceil((F.col("n") + F.col("m")) * (most / (1 + most)) - 1e-9).cast("int")
    many = many.withColumn("k", F.col("n") - common + 1).filter("k > 0").select("node_type", "norm", "n", "m", F.explode(F.expr("slice(ms, 1, k)"))).select("node_type", "norm", "n", "m", F.col("col.mark").alias("mark"))
    many = cut(many)

    def meet(t: DataFrame) -> DataFrame:
        key = ["node_type", "mark", "n", "m"]
        crowded = cut(t.filter("n <= m").groupBy(*key).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).filter("parts > 1"))
        here = t.filter("n <= m").join(crowded, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("x.norm"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        other = t.filter("n >= m").select("node_type", F.col("x").alias("y"), F.col("n").alias("m"), F.col("m").alias("n"), "mark", *[F.col("left").alias("right")] * ("left" in t.columns)).join(crowded, key, "left")
        other = other.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        # the few names of a part are held for each of the others, not the other way round
        return other.join(here, [*key, "part"]).filter("n < m or x.norm < y.norm")

    both = F.array_intersect(tokens("x.norm"), tokens("y.norm"))
    # where nothing else is in common the choice is the only one, and the sets need not be compared
    alone = ~F.arrays_overlap("left.rest", "right.rest")
    short = meet(few).filter(alone | (F.array_join(F.slice(both, F.lit(1), F.col("left.o")), " ") == F.col("mark")))
    short = short.select("x", "y", "n", "m", F.when(alone, F.col("left.o")).otherwise(F.size(both)).alias("common"))
    keys = meet(many.withColumn("x", F.struct("norm"))).select("node_type", F.least("x.norm", "y.norm").alias("a"), F.greatest("x.norm", "y.norm").alias("b")).distinct()
    sizes = {"n": F.size(tokens("x.norm")), "m": F.size(tokens("y.norm")), "common": F.size(both)}
    pairs = short.unionByName(_rows_of(keys, bare).withColumns(sizes))
    alike = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    return pairs.select("x", "y", alike.alias("alike")).filter(F.col("alike") >= most)


def _rows_of(keys: DataFrame, names: DataFrame) -> DataFrame:
    """keys(node_type, a, b) -> the rows x, y of names with these norms."""
    row = lambda key, x: names.select("node_type", F.col("norm").alias(key), F.struct(*names.columns).alias(x))
    return keys.join(row("a", "x"), ["node_type", "a"]).join(row("b", "y"), ["node_type", "b"]).select("x", "y")


def contained(names: DataFrame, most: float) -> DataFrame:
    """(node_type, a, b), a < b: the pairs of which one name contains the other and is at least `most` of it long.

    Of a name of up to LETTERS letters every part so long is looked up among the names. Most parts are none: those go by a
    table of BITS bits, where each name sets one. A longer name meets the shorter ones by their rarest trigram or pair of letters.
    """
    sub = lambda i, k: F.substring(F.col("norm"), i, k)
    size = F.length("norm")
    least = F.ceil(size * (most - 1e-9)).cast("int")
    short = names.filter((size >= 2) & (size <= LETTERS))
    lengths = F.sequence(F.greatest(F.lit(1), least), size - 1)
    fits = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: sub(i, k))))
    parts = short.filter(least < size).select("node_type", F.col("norm").alias("longer"), F.explode(F.array_distinct(fits)).alias("norm"))
    bit = F.pmod(F.xxhash64("node_type", "norm"), F.lit(BITS))
    at = lambda df: df.withColumns({"word": F.shiftright(bit, 6), "bit": (bit % 64).cast("int")})
    words = at(names).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    maybe = at(parts).join(F.broadcast(words), "word").filter("shiftright(bits, bit) & 1 = 1").select("node_type", "norm", "longer")
    within = maybe.join(names.select("node_type", "norm"), ["node_type", "norm"])

    wide = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - k + 1)), lambda i: sub(i, F.lit(k)))
    marks = cut(names.filter(size > LETTERS).select("node_type", F.col("norm").alias("longer"), F.explode(F.array_distinct(wide(GRAM))).alias("mark")))
    rarity = marks.groupBy("node_type", "mark").agg(F.count("*").alias("df"))
    probes = names.filter(size >= F.greatest(F.lit(GRAM), F.lit(int((LETTERS + 1) * (most - 1e-9))))).select("node_type", "norm", F.explode(wide(GRAM)).alias("mark"))
    rarest = probes.join(rarity, ["node_type", "mark"], "left").groupBy("node_type", "norm").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "mark")).alias("x"))
    beyond = rarest.filter("x.df > 0").select("node_type", "norm", F.col("x.mark").alias("mark")).join(marks, ["node_type", "mark"])
    beyond = beyond.filter(F.expr("norm <> longer and contains(longer, norm)") & (size >= F.length("longer") * (most - 1e-9)))
    both = within.unionByName(beyond.select("node_type", "norm", "longer"))
    return both.select("node_type", F.least("norm", "longer").alias("a"), F.greatest("norm", "longer").alias("b"))


def alike_names(names: DataFrame, most: float) -> DataFrame:
    """names(node_type, norm, ...) -> (x, y, similarity): pairs of rows of one type and two norms, in either order, with
    similarity from `most` on.

    Complete for this threshold without comparing all pairs, see alike_tokens and contained. Pairs grow faster than names, so
    no pair is shuffled that is found by its tokens, and few have their names split again.
    """
    names = cut(names.withColumn("ts", tokens("norm")))
    met = alike_tokens(names, most)
    la, lb = F.length("x.norm"), F.length("y.norm")
    share = F.least(la, lb) / F.greatest(la, lb)
    inside = F.when(F.greatest(la, lb) == 0, 0.0).when(F.expr("contains(x.norm, y.norm) or contains(y.norm, x.norm)"), share).otherwise(0.0)
    met = met.select("x", "y", F.greatest("alike", inside).alias("similarity"))
    both, all_of = F.size(F.array_intersect(tokens("x.norm"), tokens("y.norm"))), F.size(tokens("x.norm")) + F.size(tokens("y.norm"))
    rest = _rows_of(contained(names.select("node_type", "norm").distinct(), most), names.drop("ts")).filter(both / (all_of - both) < most)
    return met.unionByName(rest.select("x", "y", share.alias("similarity")).filter(F.col("similarity") >= most))


def block_by_token(entities: DataFrame, most: float = BLOCK) -> DataFrame:
    """entities(id, node_type, norm, norm_known) -> pairs (node_type, a, b, similarity) of norms, see alike_names."""
    met = alike_names(entities.select("node_type", "norm").distinct(), most)
    return met.select("x.node_type", F.least("x.norm", "y.norm").alias("a"), F.greatest("x.norm", "y.norm").alias("b"), "similarity")


def scored_names(first: DataFrame, scores: DataFrame, most: float) -> DataFrame:
    """alike_names of first(node_type, norm, id, ...) as far as the pair of their ids is one of scores(a, b, ...): (x, y, similarity)."""
    row = lambda key, x: first.select("node_type", F.col("id").alias(key), F.struct(*first.columns).alias(x))
    j = scores.select("a", "b").join(row("a", "x"), "a").join(row("b", "y"), ["node_type", "b"]).filter("x.norm <> y.norm")
    low = F.col("x.norm") < F.col("y.norm")
    j = j.select(F.when(low, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("y"))
    return j.withColumn("similarity", string_similarity(F.col("x.norm"), F.col("y.norm"))).filter(F.col("similarity") >= most)


def candidates(names: DataFrame, most: float = BLOCK, scores: DataFrame | None = None, only_scored: bool = False) -> DataFrame:
    """names(node_type, name, norm, norm_known), each name once -> (node_type, a, b, similarity, alias), a < b.

    Names of one normal form meet their first name in byte order, with similarity 1 (all pairs of a form follow from these);
    alias tells whether the form is of the alias table. Forms that are alike (see alike_names) meet by their first names.
    scores(a, b, score), each pair once, a < b: adds `score`, which goes with the names, so that no pair is shuffled for it.
    only_scored: leaves out the pairs of two forms that have no score.
    """
    first = names.groupBy("node_type", "norm").agg(F.min("name").alias("id"))
    extra = []
    if scores is not None:
        of = scores.groupBy(F.col("a").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("b", "score"))).alias("scores"))
        first, extra = first.join(of, "id", "left"), ["score"]
    first = cut(first)
    told = lambda df: df.withColumn("score", F.expr("try_element_at(scores, b)")) if extra else df
    star = names.join(first, ["node_type", "norm"]).filter("name <> id").select("node_type", F.col("id").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("similarity"), F.col("norm_known").alias("alias"), *["scores"] * len(extra))
    met = scored_names(first, scores, most) if only_scored else alike_names(first, most)
    low = F.col("x.id") < F.col("y.id")
    between = met.select("x.node_type", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), "similarity", F.lit(False).alias("alias"), *[F.when(low, F.col("x.scores")).otherwise(F.col("y.scores")).alias("scores") for _ in extra])
    return told(star).unionByName(told(between)).select("node_type", "a", "b", "similarity", "alias", *extra)


def spelled(names: DataFrame, most: float = BLOCK) -> DataFrame:
    """names(node_type, name, norm), each name once -> (node_type, a, b, similarity), a < b: all pairs of names whose forms are
    one or alike, where candidates has those of the forms' first names.

    The forms meet as in alike_names, and each takes its spellings along, in rows of SPELLINGS about."""
    many = names.groupBy("node_type", "norm").agg(F.ceil(F.count("*") / SPELLINGS).cast("int").alias("parts")).filter("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"), F.lit(0))
    rows = names.join(many, ["node_type", "norm"], "left").groupBy("node_type", "norm", part.alias("part")).agg(F.collect_list("name").alias("names"))
    forms = cut(rows)
    side = lambda x: forms.select("node_type", "norm", F.struct(*forms.columns).alias(x))
    one = side("x").filter("size(x.names) > 1 or x.part > 0").join(side("y"), ["node_type", "norm"]).filter("x.part >= y.part").select("node_type", "x", "y", F.lit(1.0).alias("similarity"))
    two = alike_names(forms, most).select("x.node_type", "x", "y", "similarity")
    both = one.unionByName(two).withColumn("itself", F.expr("x.norm = y.norm and x.part = y.part"))
    both = both.select("node_type", "similarity", "itself", F.col("y.names").alias("ys"), F.explode("x.names").alias("a")).select("node_type", "similarity", "itself", "a", F.explode("ys").alias("b"))
    # a row of names that meets itself has each pair twice
    return both.filter("a < b or not itself").select("node_type", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def best_scores(embedding: DataFrame) -> DataFrame:
    """embedding(a, b, score) in either order -> each pair once, a < b, with its best score."""
    return embedding.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


def resolve(pairs: DataFrame, embedding: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (similarity, alias, perhaps score) -> confidence and decision. embedding(a, b, score): in either order,
    where known, if the pairs have no score yet."""
    if embedding is not None:
        pairs = pairs.withColumns({"k1": F.least("a", "b"), "k2": F.greatest("a", "b")}).join(best_scores(embedding).toDF("k1", "k2", "score"), ["k1", "k2"], "left").drop("k1", "k2")
    score = F.col("score") if "score" in pairs.columns else None
    c = pair_confidence(F.col("similarity"), F.col("alias"), score)
    return pairs.withColumn("confidence", F.round(c, 6)).withColumn("decision", F.when(F.col("confidence") >= MERGE, "merge").when(F.col("confidence") >= LINK, "link").otherwise("none"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Names and types of the extracted entities and of the seed nodes, each once; types by the label that they mean."""
    e = read(spark, d, "entities").select(as_label(F.col("type"), NODE_TYPES).alias("node_type"), "name")
    n = read(spark, d, "nodes").select(as_label(F.col("node_type"), NODE_TYPES).alias("node_type"), "name")
    rows = e.unionByName(n).filter("name is not null and node_type is not null").distinct()
    return normalized(rows, "name", alias_dim(spark), "norm")


def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "entities").filter("name is not null").select("entity_id", "name")
    return normalized(e, "name", alias_dim(spark), "norm").select("entity_id", "norm", F.col("norm_known").alias("known"))


def q_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "entity_pairs").filter("name_a is not null and name_b is not null")
    a, b = F.lower(F.trim("name_a")), F.lower(F.trim("name_b"))
    return p.select("pair_id", F.round(string_similarity(a, b), 6).alias("similarity"))


def q_pair_confidence(spark: SparkSession, d: str) -> DataFrame:
    """With the pair's own score as the embedding signal, where it has one."""
    p = read(spark, d, "entity_pairs").filter("name_a is not null and name_b is not null")
    a, b = F.lower(F.trim("name_a")), F.lower(F.trim("name_b"))
    return p.select("pair_id", F.round(pair_confidence(string_similarity(a, b), a == b, F.col("confidence")), 6).alias("confidence"))


def q_block(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of names that are alike; er_candidates_sorted has the best of those that candidates makes."""
    return spelled(_named(spark, d)).select("node_type", "a", "b", F.round("similarity", 6).alias("similarity"))


def q_candidates_sorted(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    """The first k of candidates. Few pairs are very alike, so those come first; where they are less than k, more are looked for."""
    names = cut(_named(spark, d))
    order = [F.desc("similarity"), F.col("node_type"), F.col("a"), F.col("b")]
    for least in [*(x for x in NEAR if x > BLOCK), BLOCK]:
        pairs = candidates(names, least).select("node_type", "a", "b", F.round("similarity", 6).alias("similarity"))
        top = cut(pairs.orderBy(*order).limit(k))
        # what is less alike than `least` comes after these, also when rounded
        if least == BLOCK or top.filter(F.col("similarity") >= least + 1e-6).count() >= k:
            return top.orderBy(*order).limit(k)


def _resolved(spark: SparkSession, d: str, only_scored: bool = False) -> DataFrame:
    """With the scores of entity_pairs as the embedding signal, where there is one."""
    p = read(spark, d, "entity_pairs").filter("name_a is not null and name_b is not null and confidence is not null")
    return resolve(candidates(_named(spark, d), scores=best_scores(p.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.col("confidence").alias("score"))), only_scored=only_scored))


def q_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("node_type", "a", "b", "confidence", "decision")


def q_duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per type: names, links, merges, and their share of the names.

    Two forms without a score are never linked, however alike they are: string similarity weighs .7 of .9 there, which is less
    than LINK. So those pairs, nearly all of them, are not made."""
    found = _resolved(spark, d, only_scored=True).groupBy("node_type").agg(F.count_if(F.col("decision") == "link").alias("links"), F.count_if(F.col("decision") == "merge").alias("merges"))
    total = _named(spark, d).groupBy("node_type").agg(F.count("*").alias("names"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return total.join(found, "node_type", "left").select("node_type", "names", zero("links").alias("links"), zero("merges").alias("merges"), F.round((zero("links") + zero("merges")) / F.col("names"), 6).alias("rate"))


def q_er_summary(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "entity_pairs")
    return p.agg(F.count("*").alias("evaluated"), F.count_if(F.col("should_link")).alias("links"), F.count_if(F.col("should_merge")).alias("merges"), F.round((F.count_if(F.col("should_link")) + F.count_if(F.col("should_merge"))) / F.greatest(F.lit(1), F.count("*")), 6).alias("rate"))


def pair_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of unordered pairs (a, b); 0 where undefined."""
    p = predicted.select("a", "b").distinct().withColumn("p", F.lit(1))
    t = truth.select("a", "b").distinct().withColumn("t", F.lit(1))
    c = p.join(t, ["a", "b"], "full_outer").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("p").alias("np"), F.count("t").alias("nt"))
    prec, rec = F.coalesce(F.try_divide("tp", "np"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "nt"), F.lit(0.0))
    return c.select("tp", "np", "nt", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)), 6).alias("f1"))


def q_er_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Pairs scored from 0.85 on, against those judged to merge."""
    p = read(spark, d, "entity_pairs").filter("name_a is not null and name_b is not null").select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "confidence", "should_merge")
    return pair_metrics(p.filter(F.col("confidence") >= LINK), p.filter("should_merge"))


def q_top_duplicates(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "entity_pairs").filter("should_merge and confidence is not null")
    return p.orderBy(F.desc("confidence"), "pair_id").limit(20).select("pair_id", "name_a", "name_b", "confidence")


_AL = f"al(alias, canonical) AS (VALUES {sql_values(sorted(({a: c for c, xs in ALIASES.items() for a in xs} | {c: c for c in ALIASES}).items()))})"
_TOK = r"list_distinct(regexp_split_to_array({}, '[\s\-_/]+'))"


def _sim(a: str, b: str) -> str:
    ta, tb = _TOK.format(a), _TOK.format(b)
    jac = f"len(list_intersect({ta}, {tb}))::double / len(list_distinct(list_concat({ta}, {tb})))"
    cont = f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN least(length({a}), length({b}))::double / greatest(length({a}), length({b})) ELSE 0.0 END"
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE greatest({jac}, {cont}) END"


_PAIRS = "WITH p AS (SELECT *, lower(trim(name_a, ' ')) AS a, lower(trim(name_b, ' ')) AS b FROM entity_pairs WHERE name_a IS NOT NULL AND name_b IS NOT NULL)"
_NORM = r"lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_NAMES = f"""WITH {_AL}, nm AS (SELECT DISTINCT t AS node_type, name FROM (SELECT {sql_label('type', NODE_TYPES)} AS t, name FROM entities UNION ALL SELECT {sql_label('node_type', NODE_TYPES)}, name FROM nodes) WHERE t IS NOT NULL AND name IS NOT NULL),
nn AS (SELECT node_type, name, coalesce(canonical, {_NORM.format('name')}) AS norm, canonical IS NOT NULL AS known FROM nm LEFT JOIN al ON {_NORM.format('name')} = alias)"""
_BLK = f"""{_NAMES},
fs AS MATERIALIZED (SELECT node_type, norm, min(name) AS name, any_value(known) AS known FROM nn GROUP BY 1, 2),
st AS (SELECT nn.node_type, fs.name AS a, nn.name AS b, 1.0::double AS similarity, nn.known AS alias FROM nn JOIN fs USING (node_type, norm) WHERE nn.name <> fs.name),
bl AS (SELECT x.node_type, least(x.name, y.name) AS a, greatest(x.name, y.name) AS b, {_sim('x.norm', 'y.norm')} AS similarity, false AS alias FROM fs x JOIN fs y ON x.node_type = y.node_type AND x.norm < y.norm),
bk AS MATERIALIZED (SELECT * FROM st UNION ALL SELECT * FROM bl WHERE similarity >= {BLOCK}),
em AS (SELECT least(name_a, name_b) AS k1, greatest(name_a, name_b) AS k2, max(confidence) AS score FROM entity_pairs WHERE name_a IS NOT NULL AND name_b IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2),
cf AS (SELECT bk.*, round(((similarity::double * (CASE WHEN score IS NOT NULL THEN 0.5 ELSE 0.7 END)::double + alias::int * 0.2::double + coalesce(score, 0.0) * (CASE WHEN score IS NOT NULL THEN 0.3 ELSE 0.0 END)::double) / ((CASE WHEN score IS NOT NULL THEN 0.5 ELSE 0.7 END) + 0.2 + (CASE WHEN score IS NOT NULL THEN 0.3 ELSE 0.0 END))::double), 6) AS confidence FROM bk LEFT JOIN em ON least(a, b) = k1 AND greatest(a, b) = k2),
rs AS (SELECT node_type, a, b, confidence, CASE WHEN confidence >= 0.95 THEN 'merge' WHEN confidence >= 0.85 THEN 'link' ELSE 'none' END AS decision FROM cf)"""
QUERIES = {
    "normalize_name": q_normalize,
    "string_similarity": q_similarity,
    "pair_confidence": q_pair_confidence,
    "er_block": q_block,
    "resolve_entities": q_resolve,
    "er_candidates_sorted": q_candidates_sorted,
    "er_duplicate_rate": q_duplicate_rate,
    "er_summary": q_er_summary,
    "er_metrics": q_er_metrics,
    "er_top_duplicates": q_top_duplicates,
}
SQL = {
    "normalize_name": f"WITH {_AL} SELECT entity_id, coalesce(canonical, {_NORM.format('name')}) AS norm, canonical IS NOT NULL AS known FROM entities LEFT JOIN al ON {_NORM.format('name')} = alias WHERE name IS NOT NULL",
    "string_similarity": _PAIRS + f" SELECT pair_id, round({_sim('a', 'b')}, 6) AS similarity FROM p",
    "pair_confidence": _PAIRS + f" SELECT pair_id, round((({_sim('a', 'b')})::double * (CASE WHEN confidence IS NOT NULL THEN 0.5 ELSE 0.7 END)::double + (a = b)::int * 0.2::double + coalesce(confidence, 0.0) * (CASE WHEN confidence IS NOT NULL THEN 0.3 ELSE 0.0 END)::double) / ((CASE WHEN confidence IS NOT NULL THEN 0.5 ELSE 0.7 END) + 0.2 + (CASE WHEN confidence IS NOT NULL THEN 0.3 ELSE 0.0 END))::double, 6) AS confidence FROM p",
    "er_block": _NAMES + f" SELECT x.node_type, x.name AS a, y.name AS b, round({_sim('x.norm', 'y.norm')}, 6) AS similarity FROM nn x JOIN nn y ON x.node_type = y.node_type AND x.name < y.name WHERE {_sim('x.norm', 'y.norm')} >= {BLOCK}",
    "er_candidates_sorted": _BLK + " SELECT node_type, a, b, round(similarity, 6) AS similarity FROM bk ORDER BY 4 DESC, node_type, a, b LIMIT 100",
    "resolve_entities": _BLK + " SELECT * FROM rs",
    "er_duplicate_rate": _BLK + ", tt AS (SELECT node_type, count(*) AS names FROM nn GROUP BY 1), ff AS (SELECT node_type, count(*) FILTER (decision = 'link') AS links, count(*) FILTER (decision = 'merge') AS merges FROM rs GROUP BY 1) SELECT node_type, names, coalesce(links, 0) AS links, coalesce(merges, 0) AS merges, round((coalesce(links, 0) + coalesce(merges, 0)) / names, 6) AS rate FROM tt LEFT JOIN ff USING (node_type)",
    "er_summary": "SELECT count(*) AS evaluated, count(*) FILTER (should_link) AS links, count(*) FILTER (should_merge) AS merges, round((count(*) FILTER (should_link) + count(*) FILTER (should_merge)) / greatest(1, count(*)), 6) AS rate FROM entity_pairs",
    "er_metrics": "WITH p AS (SELECT least(name_a, name_b) AS a, greatest(name_a, name_b) AS b, confidence, should_merge FROM entity_pairs WHERE name_a IS NOT NULL AND name_b IS NOT NULL), pr AS (SELECT DISTINCT a, b FROM p WHERE confidence >= 0.85), tr AS (SELECT DISTINCT a, b FROM p WHERE should_merge), c AS (SELECT (SELECT count(*) FROM pr JOIN tr USING (a, b)) AS tp, (SELECT count(*) FROM pr) AS np, (SELECT count(*) FROM tr) AS nt), m AS (SELECT *, coalesce(tp::double / nullif(np, 0), 0.0) AS p, coalesce(tp::double / nullif(nt, 0), 0.0) AS r FROM c) SELECT tp, np, nt, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM m",
    "er_top_duplicates": "SELECT pair_id, name_a, name_b, confidence FROM entity_pairs WHERE should_merge AND confidence IS NOT NULL ORDER BY confidence DESC, pair_id LIMIT 20",
}
