"""Attribute-value rows into wide tables.

The entry that holds for each (entity, attribute) is found by a map-side combined aggregation, so repeated entries of
a hot entity never travel together. The cells are then hash-bucketed by entity and sorted; within a bucket they are
streamed in Arrow batches, entity and attribute are encoded as row and column indexes, and the values are scattered
into one numpy array per type.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions.values import is_blank, label_key, stated_gender, stated_number
from lexspark.session import cut


@dataclass(frozen=True)
class Attribute:
    """A column of the wide table: the names it was entered under (lower case, no final colon) and its type."""

    name: str
    aliases: tuple[str, ...] = ()
    kind: str = "text"  # text, number or gender
    maximum: int | None = None


#: The attributes of participants with the names they are entered under.
PARTICIPANT_ATTRIBUTES = (
    Attribute("Gender", ("gender", "kön", "sex"), "gender"),
    Attribute("Age", ("age", "ålder", "age_years", "age (years)", "ålder (år)"), "number"),
    Attribute("MMSE", ("mmse", "mmse-poäng", "mmse poäng", "mmse_score", "mmse score", "mmse_total", "mmse total", "mmt", "mmse (0-30)"), "number", 30),
    Attribute("Category", ("category", "kategori", "diagnos", "diagnosis"), "text"),
)


def _canonical(attributes: Sequence[Attribute]) -> Column:
    key = label_key(F.col("attr_name"))
    known = {alias: a.name for a in attributes for alias in (a.name.lower(), *a.aliases)}
    names = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key) if known else F.lit(None).cast("string")
    return F.coalesce(names, F.when(key != "", key))


def current_cells(entries: DataFrame, attributes: Sequence[Attribute], entity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per (entity, attribute): the text of the entry that is last by `order`, even if blank, as `text` (null if
    blank), `num` and `sex`. Entries without an attribute name keep their entity, with a null attribute."""
    last = entries.groupBy(*entity, _canonical(attributes).alias("attr")).agg(F.max_by("attr_value", F.struct(*order)).alias("raw"))
    num = F.lit(None).cast("double")
    for a in attributes:
        if a.kind == "number":
            num = F.when(F.col("attr") == a.name, stated_number(F.col("raw"), a.maximum)).otherwise(num)
    known_numbers = [a.name for a in attributes if a.kind == "number"]
    num = F.when(F.col("attr").isin(*known_numbers), num).otherwise(F.trim("raw").try_cast("double")) if known_numbers else F.trim("raw").try_cast("double")
    sexes = [a.name for a in attributes if a.kind == "gender"]
    sex = F.when(F.col("attr").isin(*sexes), stated_gender(F.col("raw"))) if sexes else F.lit(None).cast("string")
    return last.select(*entity, "attr", F.when(~is_blank(F.col("raw")), F.col("raw")).alias("text"), F.when(~F.isnan(num), num).alias("num"), sex.alias("sex"))


def attribute_dictionary(cells: DataFrame, declared: Sequence[Attribute], max_attributes: int = 4000) -> list[Attribute]:
    """The declared attributes and, sorted by name, all others found: number if every text of one is a number, else
    text. Their number is checked; beyond `max_attributes` columns an error is raised, nothing is dropped."""
    names = {a.name for a in declared}
    found = cells.filter(F.col("attr").isNotNull() & ~F.col("attr").isin(*names) if names else F.col("attr").isNotNull()).groupBy("attr").agg(F.count("text").alias("n"), F.count("num").alias("n_num")).limit(max_attributes + 1).collect()
    if len(found) > max_attributes:
        raise ValueError(f"more than {max_attributes} attributes do not make a wide table; raise max_attributes or name aliases")
    return [*declared, *(Attribute(r["attr"], kind="number" if r["n"] and r["n"] == r["n_num"] else "text") for r in sorted(found, key=lambda r: r["attr"]))]


def pivot_wide(entries: DataFrame, attributes: Sequence[Attribute] | None = PARTICIPANT_ATTRIBUTES, entity: Sequence[str] = ("test_code", "participant_id"), order: Sequence[str] = ("entered_at", "row_id"), discover: bool = True) -> DataFrame:
    """One row per entity with a typed column per attribute; `discover` adds the attributes that are not declared.

    The entry latest by `order` holds (nulls sort first), even if blank; values that do not state the column's type
    (several numbers, both genders, placeholders) are null. Entities are kept even if none of their entries has an
    attribute name; null entity keys are an entity of their own. Columns are named after the attributes; a name that
    clashes with an entity column, or with another one but for case, gets the suffix _attr (_attr2 ...). Extra columns
    of `entries` are ignored.
    """
    declared = list(attributes or ())
    cells = current_cells(entries, declared, entity, order)
    if discover:
        cells = cut(cells, "cells")
        columns = attribute_dictionary(cells, declared)
    else:
        columns = declared
        # other attributes keep their entity, not their value
        cells = cells.withColumn("attr", F.when(F.col("attr").isin(*[a.name for a in columns]), F.col("attr")))
    taken, names = {e.lower() for e in entity}, []
    for a in columns:
        n, k = a.name, 1
        while n.lower() in taken:
            n, k = f"{a.name}_attr{'' if k == 1 else k}", k + 1
        taken.add(n.lower())
        names.append(n)
    schema = T.StructType([*(cells.schema[e] for e in entity), *(T.StructField(n, T.DoubleType() if a.kind == "number" else T.StringType()) for n, a in zip(names, columns))])
    bucketed = cells.repartition(*entity).sortWithinPartitions(*entity)
    return bucketed.mapInArrow(_scatter(columns, names, len(entity)), schema)


def _scatter(columns: Sequence[Attribute], names: Sequence[str], n_keys: int):
    def encode(keys: list[pa.Array], n: int) -> np.ndarray:
        """Row index of each cell: the cells are sorted by entity, so an entity begins where any key changes."""
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        for k in keys:
            d = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= d[1:] != d[:-1]
        return np.cumsum(new) - 1

    def emit(batch: pa.RecordBatch, row: np.ndarray) -> pa.RecordBatch:
        rows = int(row[-1]) + 1
        first = np.searchsorted(row, np.arange(rows))
        attr = pc.index_in(batch.column(n_keys), value_set=pa.array([a.name for a in columns], pa.string())).to_numpy(zero_copy_only=False)
        attr = np.where(np.isnan(attr.astype("float64")), -1, attr).astype("int64")
        at = {"number": [], "text": [], "gender": []}
        place = np.zeros(len(columns) + 1, dtype="int64")
        for i, a in enumerate(columns):
            place[i] = len(at[a.kind])
            at[a.kind].append(i)
        done: dict[int, pa.Array] = {}
        for kind, source, dtype in (("number", n_keys + 2, "float64"), ("text", n_keys + 1, object), ("gender", n_keys + 3, object)):
            if not at[kind]:
                continue
            grid = np.full((rows, len(at[kind])), np.nan if dtype == "float64" else None, dtype=dtype)
            hit = np.isin(attr, at[kind])
            grid[row[hit], place[attr[hit]]] = batch.column(source).to_numpy(zero_copy_only=False)[hit]
            for j, i in enumerate(at[kind]):
                done[i] = pa.array(grid[:, j], pa.float64() if dtype == "float64" else pa.string(), from_pandas=True)
        keys = [batch.column(i).take(pa.array(first)) for i in range(n_keys)]
        return pa.RecordBatch.from_arrays([*keys, *(done[i] for i in range(len(columns)))], names=[*batch.schema.names[:n_keys], *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            whole = t.combine_chunks().to_batches()[0]
            row = encode([whole.column(i) for i in range(n_keys)], whole.num_rows)
            cut_at = int(np.searchsorted(row, row[-1]))  # the last entity may go on in the next batch
            if cut_at:
                yield emit(whole.slice(0, cut_at), row[:cut_at])
            held = pa.Table.from_batches([whole.slice(cut_at)])
        if held is not None and held.num_rows:
            last = held.combine_chunks().to_batches()[0]
            yield emit(last, encode([last.column(i) for i in range(n_keys)], last.num_rows))

    return run


def null_cells(wide: DataFrame, names: Sequence[str], entity: Sequence[str] = ("test_code", "participant_id")) -> DataFrame:
    """The empty cells of the named columns as rows: entity, attr_name."""
    empty = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    return wide.select(*entity, F.explode(empty).alias("attr_name"))
