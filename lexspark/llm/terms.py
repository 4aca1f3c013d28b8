"""Frequency of every distinct term, in all and by records, with last-seen counters.

Terms are read from whole records, hash-partitioned by term and ordered by record; a counter then needs only the
occurrences, the records and the last record seen, never a set of records. A term that a third of all records hold is
spread over `salts` partitions by its record, so that counts of different partitions belong to different records and
simply add up.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that are no terms.
NO_TERMS = ("", "nan", "none")
_BLANK = r"[\pZ\s\x0b\x85\x{200b}\x{feff}]"
_EDGE = r"[\pZ\s\x0b\x85\x{200b}\x{feff}\pP\pS]"


def normalize_terms(raw: pa.Array) -> pa.Array:
    """Lower case, composed form, inner blanks as one space, no blanks, punctuation or symbols around; no term: null."""
    # Arrow's own utf8_normalize leaves letters decomposed, so the distinct texts of a batch are composed one by one
    coded = raw.cast(pa.string()).dictionary_encode()
    composed = [None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).lower()) for x in coded.dictionary.to_pylist()]
    t = pa.array(composed, pa.string())
    t = pc.replace_substring_regex(t, f"{_BLANK}+", " ")
    t = pc.replace_substring_regex(t, f"^{_EDGE}+|{_EDGE}+$", "")
    return pc.if_else(pc.is_in(t, value_set=pa.array(NO_TERMS)), pa.scalar(None, pa.string()), t).take(coded.indices)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, list) -> (term, record, n), repeats within a batch combined."""
    for b in batches:
        lists = b.column(1)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        record = b.column(0).take(pc.list_parent_indices(lists))
        term = normalize_terms(pc.list_flatten(lists))
        t = pa.table({"term": term, "record": record}).filter(pc.is_valid(term))
        if t.num_rows:
            yield from t.group_by(["term", "record"]).aggregate([([], "count_all")]).rename_columns(["term", "record", "n"]).combine_chunks().to_batches()


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (term, record, n) -> (term, occurrences, records): partial sums, one or more rows a term."""
    term_before = record_before = None
    first = True
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        term, record = b.column(0), b.column(1)
        tc = term.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        rc = record.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new_term = np.ones(n, dtype=bool)
        new_term[1:] = tc[1:] != tc[:-1]
        new_record = new_term.copy()
        new_record[1:] |= rc[1:] != rc[:-1]
        if not first and term[0].as_py() == term_before:
            new_record[0] = record[0].as_py() != record_before
        seen = new_record & record.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new_term)
        yield pa.RecordBatch.from_arrays(
            [term.take(pa.array(at)), pa.array(np.add.reduceat(b.column(2).to_numpy(), at)), pa.array(np.add.reduceat(seen.astype("int64"), at))], names=["term", "occurrences", "records"]
        )
        term_before, record_before, first = term[n - 1].as_py(), record[n - 1].as_py(), False


def term_frequency(df: DataFrame, record: str, terms: str, rare_below: int = 3, common_above: float = 0.3, salts: int = 16) -> DataFrame:
    """term, occurrences, records, share (of all distinct records), term_mark: rare (fewer than `rare_below` records),
    common (more than `common_above` of all records) or null. A term that is both is common.

    `terms` is a list of texts per row; a record may have several rows. Every row counts for the occurrences. Null
    lists and elements bring no terms, but their record counts among all records; terms of a null record count as
    occurrences only. An empty table gives no rows.
    """
    total = df.agg(F.count_distinct(record)).first()[0]
    rows = df.select(F.col(record).cast("string").alias("record"), F.col(terms).cast("array<string>").alias("terms")).filter(F.size("terms") > 0)
    tokens = rows.mapInArrow(_tokens, "term string, record string, n bigint")
    placed = tokens.withColumn("_salt", F.pmod(F.xxhash64("record"), F.lit(salts))).repartition("term", "_salt").sortWithinPartitions("term", "record")
    counted = placed.select("term", "record", "n").mapInArrow(_last_seen, "term string, occurrences bigint, records bigint")
    out = counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    share = F.col("records") / F.lit(float(total or 1))
    mark = F.when(share > common_above, "common").when(F.col("records") < rare_below, "rare")  # 1800 / 6000 is 0.3, 0.3 * 6000 may not be 1800
    return out.select("term", "occurrences", "records", share.alias("share"), mark.alias("term_mark"))
