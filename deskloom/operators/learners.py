"""Model-backed operators: features by joins, models by Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.functions.intents import label_name
from deskloom.functions.rules import OTHER, STOP_WORDS
from deskloom.functions.text import strip
from deskloom.operators.grams import Splitter, hash_terms, splitter
from deskloom.operators.metrics import majority_class
from deskloom.operators.vectors import explode_terms
from deskloom.session import materialize

TWO_CHARS = r"[\p{L}\p{N}_]{2,}"


def majority_predict(df: DataFrame, label: str, confidence: float = 0.345) -> DataFrame:
    """Every row predicted as the most frequent label, with a fixed confidence."""
    top = majority_class(df, label).select("majority")
    return df.withColumn("predicted", top.scalar()).withColumn("confidence", F.lit(confidence))


def with_vectors(df: DataFrame, size: int, entries: str, name: str = "features") -> DataFrame:
    """``df`` with the array of (idx, w) ``entries`` as a sparse ML vector.

    The vector's storage struct is declared to be the vector as it passes an Arrow boundary;
    nothing is parsed or printed."""
    ordered = F.array_sort(F.col(entries))
    stored = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).alias("size"),
        F.transform(ordered, lambda e: e["idx"]).alias("indices"),
        F.transform(ordered, lambda e: e["w"]).alias("values"),
    )
    source = df.withColumn(name, stored).drop(entries)
    fields = [T.StructField(name, VectorUDT()) if f.name == name else f for f in source.schema.fields]
    return source.mapInArrow(lambda batches: batches, T.StructType(fields))


@dataclass(frozen=True)
class TextModel:
    """A fitted TF-IDF logistic regression."""

    vocabulary: DataFrame  # term, idx, idf
    size: int
    model: LogisticRegressionModel
    labels: tuple[str, ...]


def _term_rows(df: DataFrame, item: str, text: str) -> DataFrame:
    single = df.select(F.col(item).alias("_id"), F.lit("all").alias("_all"), F.col(text).alias("_text"))
    return explode_terms(single, "_id", "_all", "_text", STOP_WORDS, TWO_CHARS)


def _features(ids: DataFrame, item: str, terms: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """``ids`` with ``features``; rows without a known term get a zero vector."""
    # The vocabulary is broadcast, it has at most max_features rows: terms outside it never move.
    raw = terms.join(F.broadcast(vocabulary.select("term", "idx", "idf")), "term").select(
        "item", "idx", ((1 + F.log("tf")) * F.col("idf")).alias("w")
    )
    per_item = raw.groupBy("item").agg(
        F.collect_list(F.struct("idx", "w")).alias("_raw"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm")
    )
    entries = per_item.select("item", _unit().alias("_entries"))
    joined = ids.join(entries, F.col(item) == F.col("item"), "left").drop("item")
    return with_vectors(joined.withColumn("_entries", F.coalesce("_entries", _no_entries())), size, "_entries")


def _unit() -> Column:
    """Entries of ``_raw`` divided by ``_norm``."""
    return F.transform("_raw", lambda e: F.struct(e["idx"].alias("idx"), (e["w"] / F.col("_norm")).alias("w")))


def _no_entries() -> Column:
    return F.expr("cast(array() as array<struct<idx: int, w: double>>)")


def fold_vocabularies(terms: DataFrame, sizes: DataFrame, folds: int, max_features: int = 3000) -> DataFrame:
    """(fold, term, idx, idf): the vocabulary of the rows outside each fold.

    ``terms`` is (fold, item, term, tf) of all rows, ``sizes`` is (fold, n). One count serves all
    folds: what a fold's training rows hold is the total less the fold's own."""
    own = terms.groupBy("term", "fold").agg(F.sum("tf").alias("own_total"), F.count(F.lit(1)).alias("own_df"))
    return _outside(materialize(own, "fold-terms"), sizes, folds, max_features).drop("total")


def _outside(own: DataFrame, sizes: DataFrame, folds: int, max_features: int) -> DataFrame:
    """(fold, term, idx, idf, total) from the counts (term, fold, own_total, own_df)."""
    every = own.groupBy("term").agg(F.sum("own_total").alias("all_total"), F.sum("own_df").alias("all_df"))
    grid = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    left = grid.join(own, ["term", "fold"], "left").select(
        "fold",
        "term",
        (F.col("all_total") - F.coalesce("own_total", F.lit(0))).alias("total"),
        (F.col("all_df") - F.coalesce("own_df", F.lit(0))).alias("df"),
    )
    frequent = F.row_number().over(Window.partitionBy("fold").orderBy(F.col("total").desc(), "term"))
    top = left.filter("df > 0").withColumn("_rn", frequent).filter(F.col("_rn") <= max_features)
    rows = sizes.agg(F.sum("n")).first()[0] or 0  # rows of the folds
    trained = sizes.select("fold", (F.lit(rows) - F.col("n")).alias("trained"))
    position = F.row_number().over(Window.partitionBy("fold").orderBy("term")) - 1  # at most max_features rows
    return top.join(trained, "fold", "left").select(
        "fold",
        "term",
        position.cast("int").alias("idx"),
        (F.log((F.lit(1.0) + F.coalesce("trained", F.lit(rows))) / (1 + F.col("df"))) + 1).alias("idf"),
        "total",
    )


#: Terms that are counted together, the share of them that makes a term a candidate, the part of what
#: the last of the best terms has that keeps it one, and most candidates.
COUNTED, SHARE, PART, CANDIDATES = 2_000_000, 4e-6, 0.5, 1_000_000


def _candidates(texts: DataFrame, split: Splitter, share: float, part: float, most: int) -> tuple[np.ndarray, float] | None:
    """(hashes, total): sorted hashes of terms, with all those that occur ``total`` times or more.

    Terms are counted in runs of ``COUNTED`` of them, and a run tells those that make up ``share``
    of it. What no run tells makes up less than ``share`` of all. ``None`` if there are too many."""

    def told(run: np.ndarray) -> pa.RecordBatch:
        hashed, n = np.unique(run, return_counts=True)
        often = n >= share * len(run)
        seen = np.full(int(often.sum()) + 1, len(run))  # a last row without a term counts the run
        hashes = pa.concat_arrays([pa.array(hashed[often].view(np.int64)), pa.nulls(1, pa.int64())])
        return pa.record_batch([hashes, pa.array(np.append(n[often], len(run))), pa.array(seen)], ["hash", "n", "seen"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, size = [], 0
        for batch in batches:
            for piece in split.pieces(batch["text"]):
                run, size = [*run, piece.hash], size + len(piece.hash)
                if size >= COUNTED:
                    yield told(np.concatenate(run))
                    run, size = [], 0
        if size:
            yield told(np.concatenate(run))

    runs = texts.select("text").mapInArrow(count, "hash long, n long, seen long")
    counted = materialize(runs.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "frequent-terms")
    every = counted.filter("hash is null").agg(F.sum("n")).first()[0] or 0
    known = counted.filter("hash is not null")
    best = known.orderBy(F.col("n").desc()).limit(most).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")).first()
    # A part of what the last of all rows' best terms has: folds leave some rows to a model.
    total = max(share * every, part * best["n"] if best["rows"] == most else 0)
    kept = known.filter(F.col("n") + share * (F.lit(every) - F.col("seen")) >= total)
    if kept.count() > max(CANDIDATES, 8 * most):
        return None
    return np.sort(kept.select("hash").toArrow()["hash"].to_numpy().view(np.uint64)), total


def _hit_rows(texts: DataFrame, dealt: DataFrame, split: Splitter, kept: np.ndarray) -> DataFrame:
    """``dealt`` with (ids, tfs): places in ``kept`` of the terms of its item and how often they come;
    (told, terms): each term once or more, at one of its rows. A written table."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(len(kept), bool)
        for batch in batches:
            rows, n = [], len(batch)
            told, terms = [], []
            for piece in split.pieces(batch["text"]):
                place = np.minimum(np.searchsorted(kept, piece.hash), len(kept) - 1)
                at = np.flatnonzero(kept[place] == piece.hash)
                place = place[at]
                rows.append(piece.row[at].astype(np.int64) * len(kept) + place)
                first, where = np.unique(place, return_index=True)
                new = ~known[first]
                known[first] = True
                told += first[new].tolist()
                terms += [piece.name(i) for i in at[where[new]].tolist()]
            pairs, tf = np.unique(np.concatenate(rows or [np.zeros(0, np.int64)]), return_counts=True)
            row, place = np.divmod(pairs, len(kept))
            ends = _ends(row, n)
            named = pa.array(np.append(0, np.full(n, len(told))), pa.int32())  # all at the first row
            columns = [
                batch["item"],
                pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
                pa.ListArray.from_arrays(named, pa.array(told, pa.int32())),
                pa.ListArray.from_arrays(named, pa.array(terms, pa.string())),
            ]
            yield pa.record_batch(columns, ["item", "ids", "tfs", "told", "terms"])

    lists = "ids array<int>, tfs array<int>, told array<int>, terms array<string>"
    schema = T.StructType([texts.schema["item"], *T.StructType.fromDDL(lists).fields])
    if not len(kept):
        empty = [F.lit(None).cast(schema[c].dataType).alias(c) for c in ("ids", "tfs", "told", "terms")]
        return materialize(dealt.select("*", *empty), "fold-rows")
    found = texts.select("item", "text").mapInArrow(hits, schema)
    whole = [F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "tfs", "told", "terms")]
    return materialize(dealt.join(found.groupBy("item").agg(*whole), "item", "left"), "fold-rows")


def _ends(row: np.ndarray, n: int) -> pa.Array:
    """Offsets of the lists of ``n`` rows whose entries belong to ``row``, ascending."""
    return pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n)[:n])), pa.int32())


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, tf) of the entries of a batch of ``_hit_rows``."""
    sizes = pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy(zero_copy_only=False)
    ids, tfs = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("ids", "tfs"))
    return np.repeat(np.arange(len(sizes)), sizes), ids, tfs


def _own_counts(rows: DataFrame, folds: int, size: int) -> DataFrame:
    """(term, fold, own_total, own_df) of the terms in ``rows``; a task adds up its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = np.zeros(folds * size), np.zeros(folds * size, np.int64)
        for batch in batches:
            row, ids, tfs = _entries(batch)
            cell = batch["fold"].to_numpy(zero_copy_only=False).astype(np.int64)[row] * size + ids
            total += np.bincount(cell, tfs, minlength=len(total))
            once = np.unique(row * np.int64(size) + ids, return_index=True)[1]  # an item may have several texts
            df += np.bincount(cell[once], minlength=len(df))
        some = np.flatnonzero(df)
        columns = [some // size, some % size, total[some].astype(np.int64), df[some]]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["fold", "id", "total", "df"])

    counts = rows.select("fold", "ids", "tfs").mapInArrow(count, "fold long, id long, total long, df long")
    summed = counts.groupBy("fold", "id").agg(F.sum("total").alias("own_total"), F.sum("df").alias("own_df"))
    names = rows.filter(F.size("told") > 0).select(F.inline(F.arrays_zip("told", "terms")))
    named = names.groupBy(F.col("told").cast("long").alias("id")).agg(F.min("terms").alias("term"))
    return summed.join(named, "id").select("term", F.col("fold").cast("int").alias("fold"), "own_total", "own_df")


@dataclass(frozen=True)
class FoldTable:
    """Rows of all folds with the terms of their items, and the vocabulary of each fold's model."""

    rows: DataFrame  # fold, item, label, ids, tfs
    places: tuple[np.ndarray, ...]  # of each model: the position of each id in its vocabulary, or -1
    idfs: tuple[np.ndarray, ...]  # of each model: idf by position
    size: int

    def vectors(self, models: Sequence[int], rows: DataFrame | None = None) -> DataFrame:
        """(model, fold, item, label, features) of ``rows`` for each of ``models``; made anew when read."""
        places, idfs, size = self.places, self.idfs, self.size

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, (row, ids, tfs) = len(batch), _entries(batch)
                for m in models:
                    place = places[m][ids]
                    some = place >= 0
                    cells, of = np.unique(row[some] * np.int64(size) + place[some], return_inverse=True)
                    r, i = np.divmod(cells, size)
                    w = (1 + np.log(np.bincount(of, tfs[some], minlength=len(cells)))) * idfs[m][i]
                    norm = np.sqrt(np.bincount(r, w * w, minlength=n))
                    ends = _ends(r, n)
                    lists = [pa.ListArray.from_arrays(ends, c) for c in (pa.array(i, pa.int32()), pa.array(w / norm[r]))]
                    kind = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32))]
                    vector = pa.StructArray.from_arrays([*kind, *lists], ["type", "size", "indices", "values"])
                    model = pa.array(np.full(n, m, np.int32))
                    columns = [model, batch["fold"], batch["item"], batch["label"], vector]
                    yield pa.record_batch(columns, ["model", "fold", "item", "label", "features"])

        source = (self.rows if rows is None else rows).select("fold", "item", "label", "ids", "tfs")
        own = [source.schema[c] for c in ("fold", "item", "label")]
        schema = T.StructType([T.StructField("model", T.IntegerType()), *own, T.StructField("features", VectorUDT())])
        return source.mapInArrow(weigh, schema)


def fold_table(
    texts: DataFrame, dealt: DataFrame, item: str, text: str, label: str, folds: int, max_features: int = 3000
) -> FoldTable:
    """The terms of all rows that some fold's model knows, and the models' vocabularies.

    ``texts`` holds (item, text) and ``dealt`` (item, label, fold) of the same rows. Texts are split
    into hashes of terms, once to find the frequent ones and once to count these for each item; no
    other term is written or moved. Whether the candidates held all that a vocabulary takes is
    checked by the exact counts; if not, more are taken."""
    known = texts.select(F.col(item).alias("item"), F.lower(F.col(text)).alias("text")).filter("item is not null")
    ids = dealt.select(F.col(item).alias("item"), "fold", F.col(label).alias("label"))
    sizes = dealt.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    split = splitter(texts.sparkSession, STOP_WORDS, 2)
    share, part = SHARE, PART
    while found := _candidates(known, split, share, part, max_features):
        kept, total = found
        rows = _hit_rows(known, ids, split, kept)
        own = materialize(_own_counts(rows, folds, len(kept)), "fold-terms")
        vocabulary = _outside(own, sizes, folds, max_features).collect()  # at most folds * max_features rows
        least = [[r["total"] for r in vocabulary if r["fold"] == f] for f in range(folds)]
        if total <= 1 or all(len(t) == max_features and min(t) >= total for t in least):
            break
        share, part = share / 16, part / 16
    else:  # the most frequent terms aren't frequent: all are counted as rows
        single = _term_rows(texts, item, text).join(dealt.select(F.col(item).alias("item"), "fold"), "item")
        terms = materialize(single.select("fold", "item", "term", "tf"), "all-terms")
        vocabulary = fold_vocabularies(terms, sizes, folds, max_features).collect()
        kept = np.unique(hash_terms(sorted({r["term"] for r in vocabulary})))
        rows = _hit_rows(known, ids, split, kept)
    places = tuple(np.full(max(len(kept), 1), -1, np.int32) for _ in range(folds))
    idfs = tuple(np.zeros(max_features) for _ in range(folds))
    for r, i in zip(vocabulary, np.searchsorted(kept, hash_terms([r["term"] for r in vocabulary])).tolist()):
        places[r["fold"]][i], idfs[r["fold"]][r["idx"]] = r["idx"], r["idf"]
    return FoldTable(rows, places, idfs, max_features)


def fold_features(
    dealt: DataFrame, item: str, text: str, label: str, folds: int, max_features: int = 3000
) -> DataFrame:
    """(model, fold, item, label, features) of every row for the model of each fold.

    ``model`` numbers the fold that the model leaves out, ``fold`` is the row's own."""
    return fold_table(dealt, dealt, item, text, label, folds, max_features).vectors(range(folds))


def text_regression(rows: int, max_iter: int) -> LogisticRegression:
    """Estimator on ``features`` and ``_y``: the penalty is 1/rows, an inverse strength of 1 on the
    summed loss."""
    return LogisticRegression(
        featuresCol="features",
        labelCol="_y",
        regParam=1.0 / max(rows, 1),
        standardization=False,
        maxIter=max_iter,
        family="multinomial",
    )


def fit_text_model(
    df: DataFrame,
    item: str,
    text: str,
    label: str,
    labels: Sequence[str],
    max_features: int = 3000,
    max_iter: int = 1000,
) -> TextModel:
    """TF-IDF (1- and 2-grams, sublinear tf) with multinomial logistic regression.

    The vocabulary is the ``max_features`` most frequent terms. ``label`` is the position in
    ``labels``.
    """
    terms = materialize(_term_rows(df, item, text), "train-terms")
    rows = df.count()
    frequent = (
        terms.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
        .orderBy(F.col("total").desc(), "term")
        .limit(max_features)
    )
    position = (F.row_number().over(Window.partitionBy().orderBy("term")) - 1).cast("int")
    vocabulary = materialize(
        frequent.select(  # at most max_features rows
            "term",
            position.alias("idx"),
            (F.log(F.lit(1.0 + rows) / (1 + F.col("df"))) + 1).alias("idf"),
        ),
        "vocabulary",
    )
    size = vocabulary.count()
    features = materialize(
        _features(df.select(item, F.col(label).cast("double").alias("_y")), item, terms, vocabulary, size),
        "train-features",
    )
    model = text_regression(rows, max_iter).fit(features)
    return TextModel(vocabulary, size, model, tuple(labels))


def predict_text(model: TextModel, df: DataFrame, item: str, text: str) -> DataFrame:
    """Rows with ``predicted`` and ``confidence`` (4 digits)."""
    terms = _term_rows(df, item, text)
    featured = _features(df.select(F.col(item).alias("_row")), "_row", terms, model.vocabulary, model.size)
    scored = model.model.transform(featured).select(
        "_row",
        label_name(F.col("prediction"), model.labels).alias("predicted"),
        F.round(F.array_max(vector_to_array("probability")), 4).alias("confidence"),
    )
    return df.join(scored, F.col(item) == F.col("_row")).drop("_row")


def fit_embedding_model(
    df: DataFrame, vector: str, label: str, reg: float = 0.01, max_iter: int = 100
) -> LogisticRegressionModel:
    """Multinomial logistic regression on precomputed embeddings."""
    train = df.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("_y"),
    )
    return LogisticRegression(
        featuresCol="features", labelCol="_y", regParam=reg, maxIter=max_iter, family="multinomial"
    ).fit(train)


def predict_embeddings(
    model: LogisticRegressionModel, df: DataFrame, vector: str, labels: Sequence[str]
) -> DataFrame:
    """Rows with ``predicted``, ``confidence`` (4 digits) and ``probabilities``."""
    featured = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    probs = vector_to_array("probability")
    return model.transform(featured).select(
        *df.columns,
        label_name(F.col("prediction"), labels).alias("predicted"),
        F.round(F.array_max(probs), 4).alias("confidence"),
        probs.alias("probabilities"),
    )


def blank_to_other(text: Column, intent: Column, confidence: Column) -> Column:
    """Struct (intent, confidence); a blank text is UNKNOWN with confidence 0."""
    blank = text.isNull() | (strip(text) == "")
    return F.struct(
        F.when(blank, F.lit(OTHER)).otherwise(intent).alias("intent"),
        F.when(blank, F.lit(0.0)).otherwise(confidence).alias("confidence"),
    )


def batch_scorer(
    load: Callable[[], Callable[[list[str]], "pd.DataFrame"]],
) -> Callable[[Column], Column]:
    """Column function around an external classifier.

    ``load`` runs once per Python worker and returns a function from a list of texts to a
    frame with ``intent`` and ``confidence``; it is called on Arrow batches. Blank texts
    are passed as the word ``empty``.
    """

    @F.pandas_udf("intent string, confidence double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = load()
        for texts in batches:
            filled = [t if t and t.strip() else "empty" for t in texts]
            yield classify(filled)[["intent", "confidence"]]

    return score
