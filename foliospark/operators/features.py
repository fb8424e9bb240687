"""Vocabulary, document frequencies, TF-IDF and the combined feature vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark import fixed
from foliospark.functions.base import constant_doubles, let
from foliospark.functions.features import structural_features, term_counts, terms

STRUCTURAL_NAMES = list(fixed.STRUCTURAL_FEATURES)


def lemmatise_with(
    tokens: DataFrame, lemmas: DataFrame, doc: str = "doc_id", column: str = "tokens"
) -> DataFrame:
    """Replace forms by the lemmas of a table ``(form, lemma)`` of any size; token order is kept.

    Counts every form of a document once, so a frequent form is looked up once per document.
    """
    forms = tokens.select(doc, F.explode(F.array_distinct(column)).alias("form"))
    found = forms.join(lemmas, "form").groupBy(doc).agg(
        F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("_lemmas")
    )
    joined = tokens.join(found, doc, "left")
    replaced = F.transform(
        column, lambda t: F.coalesce(F.try_element_at(F.col("_lemmas"), t), t)
    )
    return joined.withColumn(column, replaced).drop("_lemmas")


def prepared(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Replace the text by its ``_terms`` and ``_structural`` counts.  Fitting, vectors and scoring read these
    in place of the text, so a table of them takes the texts apart once for all; ``keep_text`` leaves the text beside them."""
    apart = docs.withColumns({"_terms": terms(text), "_structural": structural_features(text)})
    return apart if keep_text else apart.drop(text)


def _terms_of(docs: DataFrame, text: str) -> Column:
    return F.col("_terms") if "_terms" in docs.columns else terms(text)


def _structural_of(docs: DataFrame, text: str) -> Column:
    return F.col("_structural") if "_structural" in docs.columns else structural_features(text)


def document_terms(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, term, tf)``, exploded from counts made inside each row."""
    counted = df.select(doc, F.explode(term_counts(_terms_of(df, text))).alias("entry"))
    return counted.select(doc, "entry.term", "entry.tf")


def fit_vocabulary(
    doc_terms: DataFrame, min_df: int = fixed.MIN_DF, max_features: int = fixed.MAX_FEATURES
) -> DataFrame:
    """``(term, term_index, df, cf)``: the most frequent terms of those in enough documents.

    Equal corpus counts at the cut go to the alphabetically first term; the index is alphabetical.
    """
    totals = doc_terms.groupBy("term").agg(
        F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")
    )
    kept = (
        totals.where(F.col("df") >= min_df)
        .orderBy(F.desc("cf"), "term")
        .limit(max_features)
    )
    # One window over at most `max_features` rows.
    index = Window.partitionBy(F.lit(0)).orderBy("term")
    return kept.select("term", (F.row_number().over(index) - 1).alias("term_index"), "df", "cf")


def smooth_idf(df: Column, documents: Column) -> Column:
    return F.log((documents + 1) / (df + 1)) + 1


def sublinear_tf(tf: Column) -> Column:
    return F.log(tf) + 1


def fit_idf(vocabulary: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``idf``; ``documents`` is counted by a scalar subquery of the same plan."""
    size = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    return vocabulary.withColumn("_n", size).withColumn(
        "idf", smooth_idf(F.col("df"), F.col("_n"))
    ).drop("_n")


def fit_maxabs(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row: largest absolute value of each column."""
    return features.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in columns])


def apply_maxabs(features: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Divide by the fitted maxima; a maximum of zero leaves the column as it is."""
    # The one fitted row is read by a scalar subquery: no join.
    limits = fitted.select(F.struct(*columns)).scalar()
    scaled = {
        c: F.col(c) / F.when(F.col("_limits")[c] == 0, F.lit(1.0)).otherwise(F.col("_limits")[c])
        for c in columns
    }
    return features.withColumn("_limits", limits).withColumns(scaled).drop("_limits")


@dataclass
class FeatureModel:
    """Fitted vocabulary, idf and maxima: at most 15,000 terms and 20 numbers."""

    vocabulary: list[str]
    idf: list[float]
    max_abs: list[float]

    @property
    def width(self) -> int:
        return len(self.vocabulary) + len(self.max_abs)

    # ------------------------------------------------------------------ fitting

    @classmethod
    def fit(
        cls,
        docs: DataFrame,
        text: str = "text",
        doc: str = "doc_id",
        min_df: int = fixed.MIN_DF,
        max_features: int = fixed.MAX_FEATURES,
    ) -> FeatureModel:
        fitted = fit_idf(fit_vocabulary(document_terms(docs, doc, text), min_df, max_features), docs)
        rows = fitted.orderBy("term_index").select("term", "idf").collect()
        structural = docs.select(_structural_of(docs, text).alias("s"))
        top = structural.agg(
            *[F.max(F.get("s", F.lit(i))) for i in range(len(STRUCTURAL_NAMES))]
        ).first()
        return cls(
            [r["term"] for r in rows], [r["idf"] for r in rows], [float(v or 0.0) for v in top]
        )

    # ------------------------------------------------------------------ applying

    def sparse(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add ``tfidf`` (``indices``, ``values``; unit length, empty for unknown terms only) and
        ``structural`` (scaled).  Works inside each row: no join, no shuffle."""
        scale = constant_doubles([m if m else 1.0 for m in self.max_abs])
        structural = F.zip_with(_structural_of(docs, text), scale, lambda v, m: v / m)
        if not self.vocabulary:
            empty = F.struct(
                F.array().cast("array<int>").alias("indices"),
                F.array().cast("array<double>").alias("values"),
            )
            plain = docs.withColumn("tfidf", empty).withColumn("structural", structural)
            return plain.drop("_terms", "_structural")
        counter = CountVectorizerModel.from_vocabulary(
            self.vocabulary, inputCol="_terms", outputCol="_counts"
        )
        counted = counter.transform(docs.withColumn("_terms", _terms_of(docs, text)))
        idf = constant_doubles(self.idf)

        def weigh(counts: Column) -> Column:
            weights = F.zip_with(
                counts["indices"],
                counts["values"],
                lambda at, tf: sublinear_tf(tf) * F.get(idf, at),
            )
            return let(weights, lambda w: F.struct(counts["indices"], unit_length(w).alias("values")))

        return (
            counted.withColumn("_raw", F.unwrap_udt("_counts"))
            .withColumn("tfidf", let(F.struct("_raw.indices", "_raw.values"), weigh))
            .withColumn("structural", structural)
            .drop("_terms", "_counts", "_raw", "_structural")
        )

    def joined(self, docs: DataFrame, text: str = "text", output: str = "entries") -> DataFrame:
        """Add one struct ``indices, values``: TF-IDF block first, then the structural block."""
        offset = len(self.vocabulary)
        used = F.filter(
            F.transform("structural", lambda v, i: F.struct((i + offset).alias("i"), v.alias("v"))),
            lambda e: e["v"] != 0,
        )
        both = let(
            used,
            lambda u: F.struct(
                F.concat("tfidf.indices", F.transform(u, lambda e: e["i"])).alias("indices"),
                F.concat("tfidf.values", F.transform(u, lambda e: e["v"])).alias("values"),
            ),
        )
        return self.sparse(docs, text).withColumn(output, both).drop("tfidf", "structural")

    def plain_vectors(self, docs: DataFrame, text: str = "text", output: str = "features") -> DataFrame:
        """Add one struct ``size, indices, values``: what ``vectors`` holds, without the vector type."""
        entries = self.joined(docs, text, "_entries")
        both = F.struct(F.lit(self.width).alias("size"), "_entries.indices", "_entries.values")
        return entries.withColumn(output, both).drop("_entries")

    def vectors(self, docs: DataFrame, text: str = "text", output: str = "features") -> DataFrame:
        """Add one ML vector.

        The vector type has no SQL constructor for sparse data; reading its JSON form builds it without
        a Python worker.
        """
        form = F.struct(
            F.lit(0).alias("type"),
            F.lit(self.width).alias("size"),
            F.col("_entries.indices").alias("indices"),
            F.col("_entries.values").alias("values"),
        )
        schema = T.StructType([T.StructField("v", VectorUDT())])
        vector = F.from_json(F.to_json(F.struct(form.alias("v"))), schema)["v"]
        return self.joined(docs, text, "_entries").withColumn(output, vector).drop("_entries")


def unit_length(weights: Column) -> Column:
    """Weights divided by their Euclidean norm; an empty or zero row stays as it is."""
    norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda total, w: total + w * w))
    return let(
        norm,
        lambda n: F.transform(weights, lambda w: F.when(n > 0, w / n).otherwise(w)),
    )


def tfidf_long(model: FeatureModel, docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``(doc, term_index, weight)`` rows; a document without known terms keeps one row of nulls."""
    weighed = model.sparse(docs, text)
    pairs = F.arrays_zip(F.col("tfidf.indices"), F.col("tfidf.values"))
    return weighed.select(doc, F.explode_outer(pairs).alias("entry")).select(
        doc, F.col("entry.indices").alias("term_index"), F.col("entry.values").alias("weight")
    )


def matrix_shape(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: documents and widths of the feature blocks."""
    width = vocabulary.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = docs.agg(F.count(F.lit(1)).alias("documents")).withColumn("tfidf_features", width)
    structural = F.lit(len(STRUCTURAL_NAMES))
    return rows.select(
        "documents",
        "tfidf_features",
        structural.alias("structural_features"),
        (F.col("tfidf_features") + structural).alias("total_features"),
    )
