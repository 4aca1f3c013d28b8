"""Schemas that drift between files: header schemas, type lattice, one consistent table, ordered changes.

The header schema of a file (its labels, how often each JSON type occurs under them) is aggregated from the records of
all files in parallel; what follows - folding, differences, declarations - works on headers only, a small fraction of
the rows. The consistent table is one pass over the records: each is cast to the union schema in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.values import PLACEHOLDERS, is_blank, label_key, stated_gender, stated_number, strip, code_key
from lexspark.operators.ranking import previous_values, running_offset, spread_key
from lexspark.session import cut


@dataclass(frozen=True)
class Field:
    """A quantity, the labels it goes under (lower case, no final colon) and, if known, the type it is cast to."""

    name: str
    labels: tuple[str, ...]
    kind: str = "union"  # gender, number, code, boolean, or union: what the lattice gives
    maximum: int | None = None
    codes: dict[str, str] = field(default_factory=dict)


#: The quantities of the test sheets and the labels they are known under.
SHEET_FIELDS = (
    Field("Gender", ("gender", "kön", "sex"), "gender"),
    Field("Age", ("age", "ålder", "age_years", "age (years)", "ålder (år)"), "number"),
    Field("Category", ("category", "categories", "kategori", "diagnos", "diagnosis", "diagnosgrupp", "dx_group"), "code", codes={"1": "HC", "2": "MCI", "3": "AD", "4": "non-AD", "hc": "HC", "mci": "MCI", "ad": "AD", "nonad": "non-AD"}),
    Field("MMSE", ("mmse", "mmse_score", "mmse score", "mmse_total", "mmse total", "mmse poäng", "mmse-poäng", "mmt", "mmse (0-30)"), "number", 30),
    Field("EducationYears", ("education_years", "utbildningsår", "education"), "number"),
    Field("FirstLanguage", ("firstlanguage", "first_language", "modersmål"), "union"),
    Field("HearingAid", ("hearingaid", "hearing_aid", "hörapparat"), "boolean"),
    Field("AgeAtOnset", ("ageatonset",), "number"),
    Field("MoCA", ("moca",), "number"),
    Field("SessionMinutes", ("sessionminutes",), "number"),
    Field("Site", ("site",), "union"),
)

#: A text that states a number and nothing but a unit.
_NUMERIC = r"^[-+]?\d+(?:[.,]\d+)?\s*\p{L}*\.?$"


def promote(a: str, b: str) -> str:
    """The type-promotion lattice: void lies below every JSON type, string above; two other types meet in string."""
    if a == b or b == "void":
        return a
    return b if a == "void" else "string"


def json_kind(schema: Column) -> Column:
    """JSON type of a variant from its schema (`schema_of_variant`): number, string, boolean, array, object, or void for
    null."""
    return (
        F.when(schema.isNull() | (schema == "VOID"), "void")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.isin("BIGINT", "DOUBLE", "FLOAT") | schema.startswith("DECIMAL"), "number")
        .otherwise("string")
    )


def _field_of(label: Column, fields: Sequence[Field]) -> Column:
    known = [F.lit(x) for f in fields for lab in f.labels for x in (lab, f.name)]
    return F.coalesce(F.try_element_at(F.create_map(*known), label), label) if known else label


_FILE = ("series_id", "file_seq", "file_id")


def _once(records: DataFrame, payload: str) -> DataFrame:
    """The records (_FILE, record_no, _p) without rows delivered twice: one hash aggregation over the rows."""
    return records.select(*_FILE, "record_no", F.col(payload).alias("_p")).distinct()


def _cells(records: DataFrame, payload: str) -> DataFrame:
    """(_FILE, label, v): a row per label of a record, with its value as a variant."""
    cells = records.sparkSession.sql("SELECT r.series_id, r.file_seq, r.file_id, x.key AS raw, x.value AS v FROM {r} r, LATERAL variant_explode(try_parse_json(r._p)) AS x WHERE x.key IS NOT NULL", r=_once(records, payload))
    return cells.select(*_FILE, label_key(F.col("raw")).alias("label"), "v")


def headers(records: DataFrame, fields: Sequence[Field] = SHEET_FIELDS, payload: str = "payload", contents: bool = True) -> DataFrame:
    """Header schemas: a row per (series_id, file_seq, file_id, field, label, kind) with the number `n` of its values
    and, with `contents`, how many of them are placeholders (`n_blank`) and how many others state a number (`n_numeric`).

    Rows delivered twice count once. Payloads that are null or no JSON object bring no labels; files without any label
    have no row here (see `file_order`). A label given twice in one object makes that object unreadable.
    """
    text = strip(F.lower(F.col("v").try_cast("string")))
    looks = {"blank": F.coalesce(text.isin(*PLACEHOLDERS), F.lit(False)), "numeric": F.coalesce(text.rlike(_NUMERIC), F.lit(False))} if contents else {}
    counts = [F.count_if("blank").alias("n_blank"), F.count_if(~F.col("blank") & F.col("numeric")).alias("n_numeric")] if contents else []
    cells = _cells(records, payload).select(*_FILE, "label", F.schema_of_variant("v").alias("_s"), *[c.alias(n) for n, c in looks.items()])
    return cells.groupBy(*_FILE, "label", json_kind(F.col("_s")).alias("kind")).agg(F.count("*").alias("n"), *counts).withColumn("field", _field_of(F.col("label"), fields))


def file_order(records: DataFrame) -> DataFrame:
    """Every file (series_id, file_seq, file_id) with its place `pos` in its series, from 0. Null file_seq sorts first."""
    files = cut(records.groupBy(*_FILE).agg(F.count("*").alias("_n")).drop("_n"), "files")
    key = F.coalesce(spread_key(files, "file_seq"), F.lit(-(2**63)))
    return cut(running_offset(files, ["series_id"], key, ties=["file_seq", "file_id"], name="pos"), "order")


def _present(h: DataFrame, order: DataFrame) -> DataFrame:
    """(_FILE, pos, field, label, kind): the fields of every file under their most frequent label (the least by name if
    equal) and with the type of most of their non-null values (string before the others if equal), null without one. The
    labels and types of one field in one file are few and gathered."""
    per = h.groupBy(*_FILE, "field").agg(F.collect_list(F.struct("label", "kind", "n")).alias("c"))
    total = lambda by, best: best(F.transform(F.array_distinct(F.transform("c", lambda x: x[by])), lambda v: F.struct(F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x[by] == v, x["n"]).otherwise(0)).alias("n"), v.alias("v"))))
    kinds = F.array_max(F.filter(total("kind", lambda a: a), lambda x: x["v"] != "void"))["v"]
    label = total("label", lambda a: F.array_min(F.transform(a, lambda x: F.struct((-x["n"]).alias("n"), x["v"].alias("v")))))["v"]
    p = per.select(*[F.col(c).alias(f"_{c}") for c in _FILE], "field", label.alias("label"), kinds.alias("kind"))
    on = F.lit(True)
    for c in _FILE:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return p.join(order, on).select(*_FILE, "pos", "field", "label", "kind")


def schema_changes(records: DataFrame, fields: Sequence[Field] = SHEET_FIELDS, evidence: float | None = 0.5) -> DataFrame:
    """The ordered differences between each file and the one before it in its series: series_id, file_seq, file_id,
    field, field_label, change_kind (added, removed, renamed, retyped), before, after.

    A field goes under the labels `fields` lists for it. Labels that are not listed are fields of their own, unless what
    stands under them gives them away: where one of them goes and another comes with the same type, and they share at
    least `evidence` of their values (see `proposed_renames`), it is a renamed field; None looks at no evidence. Records
    with a null file_id form one file of their series.
    """
    h = cut(headers(records, fields, contents=False), "headers")
    order = file_order(records)
    present = cut(_present(h, order), "present")
    a = present.select(F.col("series_id").alias("s"), F.col("pos").alias("p"), F.col("field").alias("f"), F.col("label").alias("after"))
    b = present.select(F.col("series_id").alias("bs"), (F.col("pos") + 1).alias("bp"), F.col("field").alias("bf"), F.col("label").alias("before"))
    both = a.join(b, F.col("s").eqNullSafe(F.col("bs")) & (F.col("p") == F.col("bp")) & (F.col("f") == F.col("bf")), "full")
    new, old = F.col("f").isNotNull(), F.col("bf").isNotNull()
    both = both.select(F.when(new, F.col("s")).otherwise(F.col("bs")).alias("s"), F.coalesce("p", "bp").alias("p"), F.coalesce("f", "bf").alias("field"), "before", "after", F.when(~old, "added").when(~new, "removed").when(F.col("before") != F.col("after"), "renamed").alias("change_kind"))
    both = both.filter("change_kind IS NOT NULL AND p > 0")
    listed = [x for f in fields for x in f.labels]
    if evidence is not None and not h.filter(~F.col("label").isin(*listed) if listed else F.lit(True)).isEmpty():
        both = _with_evidence(both, proposed_renames(records, fields, evidence, present))
    layout = both.join(order, F.col("s").eqNullSafe(F.col("series_id")) & (F.col("p") == F.col("pos"))).select(*_FILE, "pos", "field", F.coalesce("after", "before").alias("field_label"), "change_kind", "before", "after")
    top = order.agg(F.max("pos")).first()[0] or 1
    typed = previous_values(present.filter("kind IS NOT NULL"), ["series_id", "field"], (F.col("pos") / top * 2.0**62 - 2.0**61).cast("bigint"), ["kind"], ["pos"])
    retyped = typed.filter(F.col("prev_kind") != F.col("kind")).select(*_FILE, "pos", "field", F.col("label").alias("field_label"), F.lit("retyped").alias("change_kind"), F.col("prev_kind").alias("before"), F.col("kind").alias("after"))
    return layout.unionByName(retyped).drop("pos")


def proposed_renames(records: DataFrame, fields: Sequence[Field] = SHEET_FIELDS, least: float = 0.5, present: DataFrame | None = None, sketch: int = 64) -> DataFrame:
    """(series_id, pos, before, after, score): labels that `fields` does not list, of which one is in a file and not in
    the next and the other in the next and not in that one, that carry values of the same type and share at least
    `least` of them. Each label is in one pair only, the best of both (the least by name if equal).

    The values of a label in a file are known by the least hash in each of `sketch` classes of hashes; labels meet in a
    join on type and hash, so only labels that share one ever meet."""
    present = present if present is not None else cut(_present(headers(records, fields, contents=False), file_order(records)), "present")
    listed = [x for f in fields for x in f.labels]
    unknown = present.filter(~F.col("label").isin(*listed)) if listed else present
    value = F.lower(F.trim(F.col("v").try_cast("string")))
    seen = _cells(records, "payload").filter(~F.col("label").isin(*listed) if listed else F.lit(True)).select(*_FILE, "label", F.xxhash64(value).alias("h"), value.isNotNull().alias("_v")).filter("_v").drop("_v")
    seen = seen.groupBy(*_FILE, "label", F.pmod("h", F.lit(sketch)).alias("_c")).agg(F.min("h").alias("h"))
    marks = seen.groupBy(*[F.col(c).alias(f"_{c}") for c in _FILE], F.col("label").alias("_l")).agg(F.collect_list("h").alias("marks"))
    on = F.col("label") == F.col("_l")
    for c in _FILE:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = cut(unknown.join(marks, on).select("series_id", "pos", "label", "kind", "marks"), "marks")
    there = lambda step: known.select(F.col("series_id").alias("_s"), (F.col("pos") + step).alias("_p"), F.col("label").alias("_l"))
    same = F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("pos") == F.col("_p")) & (F.col("label") == F.col("_l"))
    gone, come = known.join(there(-1), same, "left_anti"), known.join(there(1), same, "left_anti")
    g = gone.select(F.col("series_id").alias("s"), (F.col("pos") + 1).alias("pos"), F.col("kind").alias("k"), F.col("label").alias("before"), F.size("marks").alias("nb"), F.explode("marks").alias("m"))
    c = come.select("series_id", F.col("pos").alias("p"), F.col("kind").alias("kc"), F.col("label").alias("after"), F.size("marks").alias("na"), F.explode("marks").alias("mc"))
    met = g.join(c, F.col("s").eqNullSafe(F.col("series_id")) & (F.col("pos") == F.col("p")) & (F.col("k") == F.col("kc")) & (F.col("m") == F.col("mc"))).groupBy("series_id", "pos", "before", "after").agg((F.count("*") / F.least(F.first("na"), F.first("nb"))).alias("score")).filter(F.col("score") >= least)
    met = cut(met, "met")
    best = lambda k, other: met.groupBy("series_id", "pos", k).agg(F.min(F.struct((-F.col("score")).alias("x"), F.col(other).alias(other))).alias("b")).select(F.col("series_id").alias("_s"), F.col("pos").alias("_p"), F.col(k).alias("_k"), F.col(f"b.{other}").alias("_o"))
    for k, other in (("before", "after"), ("after", "before")):
        met = met.join(best(k, other), F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("pos") == F.col("_p")) & (F.col(k) == F.col("_k")) & (F.col(other) == F.col("_o")), "left_semi")
    return met


def _with_evidence(changes: DataFrame, proposed: DataFrame) -> DataFrame:
    """changes with the removed and the added label of a proposal as one renamed field."""
    r = cut(proposed.select(F.col("series_id").alias("rs"), F.col("pos").alias("rp"), F.col("before").alias("rb"), F.col("after").alias("ra")), "renames")
    here = F.col("s").eqNullSafe(F.col("rs")) & (F.col("p") == F.col("rp"))
    rest = changes.join(r, here & (((F.col("change_kind") == "removed") & (F.col("before") == F.col("rb"))) | ((F.col("change_kind") == "added") & (F.col("after") == F.col("ra")))), "left_anti")
    return rest.unionByName(r.select(F.col("rs").alias("s"), F.col("rp").alias("p"), F.col("ra").alias("field"), F.col("rb").alias("before"), F.col("ra").alias("after"), F.lit("renamed").alias("change_kind")))


def union_schema(records: DataFrame, fields: Sequence[Field] = SHEET_FIELDS, max_fields: int = 5000) -> dict[str, str]:
    """field -> type over all files: the join of all types that occur in the promotion lattice, placeholders and nulls
    being void, and a file's texts numbers if all of them state one ("16", "8 år"). Declared kinds hold. The number of fields is checked: beyond `max_fields` columns no table makes sense,
    and an error says so rather than dropping any."""
    h = headers(records, fields)
    kinds = h.groupBy("field", F.when(F.col("n") == F.col("n_blank"), "void").when((F.col("kind") == "string") & (F.col("n") == F.col("n_blank") + F.col("n_numeric")), "number").otherwise(F.col("kind")).alias("kind")).agg(F.sum("n").alias("n"))
    per = kinds.groupBy("field").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).limit(max_fields + 1).collect()  # at most six kinds each
    if len(per) > max_fields:
        raise ValueError(f"more than {max_fields} fields; raise max_fields or name their common quantities in `fields`")
    declared = {f.name: f.kind for f in fields if f.kind != "union"}
    found = {r["field"]: reduce(promote, r["kinds"], "void") for r in per}
    return {f.name: declared.get(f.name, found.get(f.name, "void")) for f in fields} | {k: found[k] for k in sorted(found) if k not in {f.name for f in fields}}


def consistent_table(records: DataFrame, fields: Sequence[Field] = SHEET_FIELDS, schema: dict[str, str] | None = None) -> DataFrame:
    """All records cast to the union schema, one row per (file_id, record_no): series_id, file_seq, file_id, record_no,
    test_code, participant_id and a column per field (clashes with those names get the suffix _field).

    Of rows with the same file_id and record_no the last arrived holds (the greater payload if equal). Numbers are read
    from texts ("26/30", "23 p") and from {"score": ..}, codes from lists and {"code": ..}; where a value cannot be
    read as the column's type it is null. Unreadable payloads give a row of nulls.
    """
    schema = schema if schema is not None else union_schema(records, fields)
    keys = ["file_id", "record_no"]
    last = records.groupBy(*keys).agg(F.max_by(F.struct("series_id", "file_seq", "test_code", "participant_id", "payload"), F.struct("arrived_at", "payload")).alias("r"))
    m = F.map_entries(F.from_json(F.col("r.payload"), "map<string,string>"))
    entries = F.filter(F.transform(m, lambda e: F.struct(label_key(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["value"].isNotNull())
    rows = last.select("r.series_id", "r.file_seq", *keys, "r.test_code", "r.participant_id", entries.alias("_e"))
    by = {f.name: f for f in fields}
    taken, out = {"series_id", "file_seq", *keys, "test_code", "participant_id"}, []
    for name, kind in schema.items():
        f = by.get(name, Field(name, (name,)))
        raw = F.get(F.filter(F.col("_e"), _under(f.labels)), F.lit(0))["value"]
        out.append(_cast(raw, kind, f).alias(f"{name}_field" if name.lower() in taken else name))
    return rows.select("series_id", "file_seq", *keys, "test_code", "participant_id", *out)


def _under(labels: Sequence[str]):
    return lambda e: e["key"].isin(*labels)


def _cast(raw: Column, kind: str, f: Field) -> Column:
    inner = F.coalesce(F.get_json_object(raw, "$.score"), F.get_json_object(raw, "$.code"), F.get_json_object(raw, "$[0]"))
    scalar = F.when(raw.rlike(r"^\s*[\[{]"), inner).otherwise(raw)
    if kind == "gender":
        return stated_gender(scalar)
    if kind == "number":
        return stated_number(scalar, f.maximum)
    if kind == "boolean":
        t = strip(F.lower(scalar))
        return F.when(t.isin("true", "ja", "yes", "1"), True).when(t.isin("false", "nej", "no", "0"), False)
    if kind == "code":
        codes = F.create_map(*[F.lit(x) for kv in f.codes.items() for x in kv])
        return F.try_element_at(codes, code_key(F.regexp_replace(scalar, r"\.0+$", "")))
    return F.when(~is_blank(raw), raw)
