"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import as_row, least_hashes, table
from weftgraph.plans.lineage import cut

#: A candidate is a run of at least 16 characters of which keys and tokens are made.
CANDIDATE = r"[A-Za-z0-9+/=_-]{16,}"
#: Characters kept of the text on both sides of a candidate.
NEAR = 60
#: Names that credentials are assigned to, and parts of paths that hold examples (fixed values).
CREDENTIAL = r"(?i)(token|secret|passwd|password|pwd|api_?-?key|apikey|access_?-?key|private_?-?key|credential|auth|bearer)"
EXAMPLE = r"(?i)(test|example|sample|fixture|mock|doc)"
#: What the forest sees. label_findings() looks at names of credentials and at signs of assignment and
#: quotes before a value, none of which is among it, and never at the value.
FEATURES = ("length", "transitions", "vowel_steps", "digits", "uppers", "symbols", "hex", "coverage", "path_example", "near_coverage", "at_sign", "line_words")


def _key(text: Column, path: Column) -> Column:
    return F.md5(F.concat(F.coalesce(path, F.lit("")), F.lit("\n"), text))


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """(key, doc_id, path, pos, start, value, before, after) of every candidate in every whole text.

    key is the MD5 of the text and the path, so that copies share it; start counts characters from 0. The text is cut
    at its candidates; an offset is the sum of the pieces and candidates up to it.
    """
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id"), path.cast("string").alias("path"), text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    d = d.select("doc_id", "path", _key(F.col("text"), F.col("path")).alias("key"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"), F.split("text", CANDIDATE).alias("pieces"))
    each = F.transform("values", lambda v, i: F.struct(v.alias("value"), F.right(F.get("pieces", i), F.lit(NEAR)).alias("before"), F.left(F.get("pieces", i + 1), F.lit(NEAR)).alias("after"), F.length(F.get("pieces", i)).alias("gap")))
    d = d.select("doc_id", "path", "key", "row", F.posexplode(each).alias("pos", "c")).select("doc_id", "path", "key", "row", "pos", "c.*")
    so_far = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("value")).over(so_far) - F.length("value")
    return d.select("key", "doc_id", "path", "pos", start.cast("long").alias("start"), "value", "before", "after")


def _place(trigram: Column) -> Column:
    """The number of three lower-case letters, from 0 to 26 ** 3 - 1."""
    a, b, c = (F.ascii(F.substring(trigram, i, 1)) - 97 for i in (1, 2, 3))
    return a * 676 + b * 26 + c


def _trigrams(text: Column) -> Column:
    """Lower-case letter trigrams of a string, with repeats."""
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: F.lower(F.substring(text, i, F.lit(3))))
    return F.filter(all_, lambda t: t.rlike("^[a-z]{3}$"))


def dictionary(found: DataFrame, least: int = 3) -> str:
    """The dictionary as a string of 26 ** 3 marks: 1 for a letter trigram that words next to
    candidates hold at least `least` times. Counted over all candidates; the driver gets 26 ** 3
    rows at most, whatever the input."""
    words = found.select(F.explode(_trigrams(F.concat_ws(" ", "before", "after"))).alias("t"))
    seen = words.groupBy(_place(F.col("t")).alias("p")).count().where(F.col("count") >= least).select("p").collect()
    places = {row["p"] for row in seen}
    return "".join("1" if p in places else "0" for p in range(26**3))


def features(found: DataFrame, marks: str) -> DataFrame:
    """found with FEATURES (doubles)."""
    v, n = F.col("value"), F.length("value").cast("double")
    kinds = v
    for pattern, letter in ((r"[a-z]", "a"), (r"[A-Z]", "A"), (r"[0-9]", "0"), (r"[^aA0]", "+")):
        kinds = F.regexp_replace(kinds, pattern, letter)
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    # letters that follow each other as in speech: a vowel after a consonant or the other way round
    steps = F.regexp_count(v, F.lit(r"(?i)[aeiouy](?=[b-df-hj-np-tv-xz])")) + F.regexp_count(v, F.lit(r"(?i)[b-df-hj-np-tv-xz](?=[aeiouy])"))
    table_ = F.split(F.lit(marks), "")
    known = lambda grams: F.size(F.filter(grams, lambda t: F.element_at(table_, (_place(t) + 1).cast("int")) == "1"))
    near = _trigrams(F.concat_ws(" ", "before", "after"))
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    yes = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    line = F.substring_index("before", "\n", -1)
    made = {
        "length": n,
        "transitions": (F.length(runs) - 1) / F.greatest(n - 1, F.lit(1.0)),
        "vowel_steps": steps / F.greatest(n - 1, F.lit(1.0)),
        "digits": count("[0-9]"),
        "uppers": count("[A-Z]"),
        "symbols": count("[^A-Za-z0-9]"),
        "hex": yes(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "coverage": known(_trigrams(v)) / F.greatest(n - 2, F.lit(1.0)),
        "path_example": yes(F.col("path").rlike(EXAMPLE)),
        "near_coverage": known(near) / F.greatest(F.size(near), F.lit(1)),
        "at_sign": yes(F.col("after").startswith("@") | F.col("before").endswith("@") | F.col("before").endswith(".")),
        "line_words": F.size(F.split(F.trim(line), r"\s+")).cast("double"),
    }
    return found.select("*", *[made[f].cast("double").alias(f) for f in FEATURES])


def label_findings(found: DataFrame) -> DataFrame:
    """found with label: 1 for a value that is assigned to the name of a credential, 0 for one that is
    assigned to nothing, null for values of other names. The value itself is never looked at, so what
    secrets look like is for the forest to learn. Labels of this kind are noisy (a credential may be
    named in prose, a secret may stand alone); they stand in for findings that people have labelled,
    which scan_secrets() takes instead."""
    named = F.col("before").rlike(CREDENTIAL + r"[\w-]*\s*(=|:|=>)\s*[\"']?$")
    assigned = F.col("before").rlike("(=|:|=>)\\s*[\"'`]?$")
    return found.withColumn("label", F.when(named, 1.0).when(~assigned, 0.0))


@dataclass
class SecretModel:
    marks: str
    forest: RandomForestClassificationModel | None
    known: float  # the score of all candidates if labels were of one kind


def learn(labelled: DataFrame, marks: str, most: int = 3000, trees: int = 20, depth: int = 6, seed: int = 5) -> SecretModel:
    """A random forest from labelled findings (value, before, after, path, label): the `most` of
    least hash of each label, each text around a value once. Rows without a label don't count; with
    findings of one label every score is that label, and with none 0."""
    rows = labelled.where("label is not null").select(F.col("label").cast("double").alias("label"), F.xxhash64("value", "before", "after").alias("h"), "value", "before", "after", "path").dropDuplicates(["h"])
    ranked = features(cut(least_hashes(rows, "label", "h", most)), marks)
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ranked).orderBy("h").select("label", "features").cache()
    kinds = [r["label"] for r in train.select("label").distinct().collect()]
    model = None
    if len(kinds) == 2:
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(train)
    train.unpersist()
    return SecretModel(marks, model, 1.0 if kinds == [1.0] else 0.0)


def score(made: DataFrame, model: SecretModel) -> DataFrame:
    if model.forest is None:
        return made.withColumn("score", F.lit(model.known))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made)
    return model.forest.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan_secrets(docs: DataFrame, path: Column | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """Findings of all whole texts: key (MD5 of path and text), doc_id, path, pos, start, value,
    before, after, the FEATURES, and score, the forest's probability that the value is a secret.

    path tells where a text comes from (default: none). labelled: findings (value, before, after,
    path) with a label of 0 or 1; without them label_findings() labels what it can of docs. Null and
    empty texts have no candidates; an empty table gives no rows; repeated rows repeat their
    findings, and equal findings get equal scores. Columns of docs other than doc_id and text play
    no part.
    """
    found = cut(candidates(docs, F.lit("") if path is None else path))  # read several times below
    marks = dictionary(found)
    return score(features(found, marks), learn(label_findings(found) if labelled is None else labelled, marks))


def redact_secrets(docs: DataFrame, path: Column | None = None, threshold: float = 0.5, mark: str = "[secret]", labelled: DataFrame | None = None) -> DataFrame:
    """docs with every finding that scores at least `threshold` replaced by `mark` where it stands;
    all rows, columns and other text stay.

    Findings are gathered by path and text, so rows without a doc_id and copies are served alike. A
    text is cut at its candidates once and put together once, however many it has. Null texts stay null; texts without candidates meet no join. An empty table gives no rows.
    """
    names, own = docs.columns, F.lit("") if path is None else path.cast("string")
    hits = F.sort_array(F.collect_set(F.struct("pos", (F.col("score") >= threshold).alias("hit"))))  # all candidates of a text
    found = scan_secrets(docs, path, labelled).groupBy(F.col("key").alias("_key")).agg(hits.alias("_hits")).where(F.exists("_hits", lambda h: h["hit"]))
    text = F.col("text").cast("string")
    d = docs.select(as_row(docs, "text"), text.alias("_text"), own.alias("_path"), F.coalesce(text.rlike(CANDIDATE), F.lit(False)).alias("_open"))
    some = d.where("_open").withColumn("_key", _key(F.col("_text"), F.col("_path"))).join(found, "_key", "left")
    values = F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))
    shown = F.transform(values, lambda v, i: F.when(F.get("_hits", i)["hit"], F.lit(mark)).otherwise(v))
    # pieces and values take turns; the last piece has no value behind it
    parts = F.zip_with(F.split("_text", CANDIDATE), shown, lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    clean = F.when(F.col("_hits").isNull(), F.col("_text")).otherwise(F.array_join(parts, ""))
    both = some.select("_row", clean.alias("_text")).union(d.where("not _open").select("_row", "_text"))
    return both.select("_row.*", F.col("_text").alias("text")).select(*[F.col(f"`{c}`") for c in names])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_secrets() of all documents, their source taken for the path; nulls, empty texts, ties,
    repeats, an empty table and further columns as stated there."""
    docs = table(spark, sf_dir, "documents")
    out = scan_secrets(docs, F.col("source"))
    return out.select("doc_id", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("secret"))
