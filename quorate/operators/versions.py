"""Versions of a lexical index: a stored base, and for each repair only what it changes.

A version is a base index, the rows that replace some of its documents (delta), and the replaced documents
(tombstones). Document frequencies and lengths are kept beside the base; a version corrects them by the
terms of the replaced and the replacing rows alone, so a repair of few documents tokenises, counts and
writes little, and all versions share the base.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.operators.retrieval import document_frequencies, idf_from, lexical_index
from quorate.session import broadcast_if_small, materialise


@dataclass
class Version:
    """``rows`` of ``lexical_index``; ``frequencies`` (term, df) and ``sizes`` (n_chunks, total) of all rows of the version."""

    base: DataFrame
    frequencies: DataFrame
    sizes: DataFrame
    delta: DataFrame | None = None
    tombstones: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """The version's index rows, read from base and delta."""
        if self.delta is None:
            return self.base
        kept = self.base.join(broadcast_if_small(self.tombstones), "source_doc", "left_anti")
        return kept.unionByName(self.delta.select(*self.base.columns))


def _sizes(index: DataFrame, sign: int = 1) -> DataFrame:
    return index.agg((F.lit(sign) * F.count("*")).alias("n_chunks"), (F.lit(sign) * F.coalesce(F.sum("dl"), F.lit(0))).alias("total"))


def first_version(chunks: DataFrame) -> Version:
    """The stored index of a corpus of chunks."""
    base = materialise(lexical_index(chunks))
    return Version(base, materialise(document_frequencies(base)), materialise(_sizes(base)))


def revised(version: Version, chunks: DataFrame, replaced: DataFrame) -> Version:
    """The version in which the documents of ``replaced`` (source_doc) have the given chunks, or none.

    ``replaced`` must name every document that ``chunks`` belongs to; a document may be new.
    """
    base = Version(version.base, version.frequencies, version.sizes).rows if version.delta is None else materialise(version.rows)
    tombstones = materialise(replaced.select("source_doc").distinct())
    delta = materialise(lexical_index(chunks))
    if not delta.join(tombstones, "source_doc", "left_anti").isEmpty():
        raise ValueError("chunks of a document that is not replaced")
    gone = materialise(base.join(broadcast_if_small(tombstones), "source_doc", "left_semi"))
    change = document_frequencies(delta).unionByName(document_frequencies(gone).withColumn("df", -F.col("df")))
    frequencies = version.frequencies.unionByName(change).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    sizes = version.sizes.unionByName(_sizes(delta)).unionByName(_sizes(gone, -1))
    sizes = sizes.agg(F.sum("n_chunks").alias("n_chunks"), F.sum("total").alias("total"))
    return Version(base, materialise(frequencies), materialise(sizes), delta, tombstones)


def idf_of(version: Version) -> DataFrame:
    """(term, idf, avgdl) of a version, from its corrected counts."""
    stats = version.sizes.select("n_chunks", (F.col("total") / F.col("n_chunks")).alias("avgdl"))
    return idf_from(version.frequencies, stats)
