"""Consensus from several annotators' labels: a community confusion model with variational updates.

Every item has a true class, every annotator belongs (softly) to a community, and a community has a confusion matrix
with a Dirichlet prior. Rounds alternate between
  - the confusion counts of every annotator given the items' class probabilities (labels join items, summed by annotator),
  - the communities: variational updates of membership, matrices and class weights, on the annotators' counts only,
  - the class probabilities of every item given the annotators' expected log matrices (labels join annotators, summed
    by item).
Several tasks that were judged together (a rating, a category, a flag) share every pass over the labels. Both sums are
combined on the map side, and an item or annotator with many labels is joined under as many salted keys, so none with a
third of all labels is gathered. Only the communities' matrices, whose size is fixed, reach the driver. Every third pass
they are extrapolated along the direction they move in, which saves more than half of the passes. An annotator with few
labels is read mostly by the matrix of the communities it may belong to, which stabilises its reliability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators.agreement import CATEGORIES
from lexspark.session import cut, release, release_shuffles


@dataclass(frozen=True)
class Task:
    """What was judged: the classes in order, and whether their order means something."""

    name: str
    classes: tuple
    ordinal: bool = False


RATING = Task("rating", (0, 1, 2, 3), ordinal=True)
CATEGORY = Task("category", CATEGORIES)
COMPOUND = Task("is_compound", (False, True))


def task_label(task: Task) -> Column:
    """The index of a judgement's class, null if it is none: ratings outside 0..3, unknown categories or flags."""
    if task.name == "rating":
        return F.when(F.col("rating").isin(*task.classes), F.col("rating").cast("int"))
    text = F.lower(F.regexp_replace(F.col(task.name).cast("string"), r"[\p{Z}\s]", ""))
    if task.name == "is_compound":
        return F.when(text.isin("true", "1", "yes", "y", "t"), 1).when(text.isin("false", "0", "no", "n", "f"), 0)
    out = F.lit(None).cast("int")
    for i, c in enumerate(task.classes):
        out = F.when(text == c, i).otherwise(out)
    return out


def communities(task: Task) -> tuple[np.ndarray, list[str]]:
    """Prior mean matrices (community x true class x label). Ordinal tasks: careful, imprecise, severe, mild, random
    and opposed annotators; nominal ones: careful, imprecise and random."""
    c = len(task.classes)
    i = np.arange(c)
    gap = np.abs(i[:, None] - i[None, :]) if task.ordinal else (i[:, None] != i[None, :]).astype(int) * 1.5

    def shaped(center: np.ndarray, width: float) -> np.ndarray:
        m = np.exp(-((np.abs(center[:, None] - i[None, :]) if task.ordinal else gap) / width))
        return m / m.sum(axis=1, keepdims=True)

    if task.ordinal:
        means = {"careful": shaped(i, 0.5), "imprecise": shaped(i, 1.0), "severe": shaped(np.maximum(i - 1, 0), 0.5), "mild": shaped(np.minimum(i + 1, c - 1), 0.5), "random": np.full((c, c), 1 / c), "opposed": shaped(c - 1 - i, 0.7)}
    else:
        means = {"careful": shaped(i, 0.5), "imprecise": shaped(i, 1.2), "random": np.full((c, c), 1 / c)}
    return np.stack(list(means.values())) * 0.97 + 0.03 / c, list(means)


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x, dtype="float64")
    x = x.astype("float64").copy()
    for _ in range(6):
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


@dataclass
class _Model:
    prior: np.ndarray
    strength: float
    matrix: np.ndarray  # Dirichlet parameters
    weight: np.ndarray  # Dirichlet parameters of the communities' sizes
    pseudo: float

    def expected(self) -> tuple[np.ndarray, np.ndarray]:
        return _digamma(self.matrix) - _digamma(self.matrix.sum(axis=2))[:, :, None], _digamma(self.weight) - _digamma(np.array([self.weight.sum()]))[0]

    def shares(self) -> np.ndarray:
        return self.matrix / self.matrix.sum(axis=2, keepdims=True)

    def membership(self, counts: np.ndarray) -> np.ndarray:
        log_m, log_w = self.expected()
        s = counts.reshape(len(counts), -1) @ log_m.reshape(len(log_m), -1).T + log_w
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    def own(self, counts: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Each annotator's matrix: its counts on top of `pseudo` judgements by the matrices of its communities."""
        mean = self.matrix / self.matrix.sum(axis=2, keepdims=True)
        c = counts.shape[1]
        full = counts + self.pseudo / c * np.einsum("rm,mcl->rcl", member, mean)
        return full


def _counts_of(b: pa.RecordBatch, at: int, c: int) -> np.ndarray:
    """Confusion counts (annotator x class x label) of the columns from `at`."""
    return np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(at, at + c * c)], axis=1).reshape(-1, c, c)


def _columns(tasks: Sequence[Task]) -> list[int]:
    """Where the counts of each task begin in the table of annotators, whose first column is the annotator."""
    return [1 + sum(len(t.classes) ** 2 for t in tasks[:i]) for i in range(len(tasks))]


def _fit(stats: DataFrame, tasks: Sequence[Task], models: Sequence[_Model], rounds: int, live: Sequence[bool]) -> None:
    """Variational updates of the communities of the live tasks on the annotators' counts, until no share of a matrix
    moves by 1e-3 or for `rounds`; only sums over all annotators come back."""
    at, open_ = _columns(tasks), [i for i, on in enumerate(live) if on]
    for _ in range(rounds):

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros(len(models[i].prior) * (len(tasks[i].classes) ** 2 + 1)) for i in open_]
            for b in batches:
                for total, i in zip(totals, open_) if b.num_rows else ():
                    counts = _counts_of(b, at[i], len(tasks[i].classes))
                    q = models[i].membership(counts)
                    total += np.concatenate([np.einsum("rm,rcl->mcl", q, counts).ravel(), q.sum(axis=0)])
            values = np.concatenate(totals)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["k", "v"])

        sums = np.zeros(sum(len(models[i].prior) * (len(tasks[i].classes) ** 2 + 1) for i in open_))
        for r in stats.mapInArrow(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums[r["k"]] = r["v"]
        moved, start = [], 0
        for i in open_:
            model, c, m = models[i], len(tasks[i].classes), len(models[i].prior)
            before = model.shares()
            model.matrix = model.strength * model.prior + sums[start : start + m * c * c].reshape(m, c, c)
            model.weight = 1.0 + sums[start + m * c * c : start + m * (c * c + 1)]
            start += m * (c * c + 1)
            moved.append(float(np.abs(model.shares() - before).max()) >= 1e-3)
        open_ = [i for i, m in zip(open_, moved) if m]
        if not open_:
            break


def _extrapolate(model: _Model, past: list[np.ndarray]) -> None:
    """Squared extrapolation of the matrices from the last three passes; each true class keeps its weight."""
    a, b, c = past[-3:]
    r, v = b - a, (c - b) - (b - a)
    step = min(max(-math.sqrt(float((r * r).sum()) / max(float((v * v).sum()), 1e-300)), -8.0), -1.0)
    share = np.exp(a - 2 * step * r + step * step * v)
    model.matrix = share / share.sum(axis=2, keepdims=True) * model.matrix.sum(axis=2, keepdims=True)


def _association(full: np.ndarray, task: Task) -> np.ndarray:
    """Reliability of each matrix of (true class x label) counts: the correlation of label with class for ordered
    classes, else the chance-corrected agreement; 0 where either does not vary."""
    w = full / np.maximum(full.sum(axis=(1, 2), keepdims=True), 1e-12)
    rows, cols = w.sum(axis=2), w.sum(axis=1)
    if task.ordinal:
        x = np.arange(full.shape[1], dtype="float64")
        mx, my = rows @ x, cols @ x
        cov = np.einsum("rcl,c,l->r", w, x, x) - mx * my
        var = (rows @ x**2 - mx**2) * (cols @ x**2 - my**2)
        return np.where(var > 1e-12, cov / np.sqrt(np.maximum(var, 1e-12)), 0.0)
    po, pe = np.einsum("rcc->r", w), (rows * cols).sum(axis=1)
    return np.where(pe < 1 - 1e-9, (po - pe) / np.maximum(1 - pe, 1e-9), 0.0)


def clean_judgements(ratings: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """(item, rater, one label column per task, named after it): one row per judgement. Of a judgement (`rating_id`)
    delivered more than once the last delivery by `loaded_at` holds, if there is that column, the greatest class
    indexes if equal; judgements without an id are told apart by their labels. Judgements without a pair or a rater
    are left out; a second round of the same rater is a judgement of its own.

    Time and labels are packed into one number, so that what holds is a hash aggregation of a maximum."""
    labels = {t.name: task_label(t) for t in tasks}
    packed, span = F.lit(0).cast("bigint"), 1
    for t in tasks:
        packed, span = packed * (len(t.classes) + 1) + F.coalesce(labels[t.name] + 1, F.lit(0)), span * (len(t.classes) + 1)
    room = 1 << (span - 1).bit_length()
    when = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(0)) if "loaded_at" in ratings.columns else F.lit(0)
    rows = ratings.select(F.col("pair_id").cast("string").alias("item"), F.col("rater_id").cast("string").alias("rater"), F.col("rating_id").alias("_id"), packed.alias("_p"), when.cast("bigint").alias("_t")).filter("item IS NOT NULL AND rater IS NOT NULL")
    apart = F.when(F.col("_id").isNull(), F.col("_p"))
    last = rows.groupBy("item", "rater", "_id", apart.alias("_h")).agg(F.max(F.col("_t") * room + F.col("_p")).alias("_m"))
    left, out = F.pmod("_m", F.lit(room)), []
    for t in reversed(tasks):
        k = len(t.classes) + 1
        out.insert(0, F.when(left % k > 0, left % k - 1).cast("tinyint").alias(t.name))
        left = F.floor(left / k)
    return last.select("item", "rater", *out)


def clean_labels(ratings: DataFrame, task: Task) -> DataFrame:
    """(item, rater, l): the judgements of one task that have a class."""
    return clean_judgements(ratings, [task]).select("item", "rater", F.col(task.name).alias("l")).filter("l IS NOT NULL")


def item_votes(judgements: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """item, and how many judgements gave it each class of each task, as v<task>_<class>."""
    return judgements.groupBy("item").agg(*[F.count_if(F.col(t.name) == k).cast("double").alias(f"v{i}_{k}") for i, t in enumerate(tasks) for k in range(len(t.classes))])


def _votes(i: int, task: Task) -> tuple[Column, Column]:
    """The number of labels of an item and the share of pairs of them that agree, null for one label or none."""
    v = [F.col(f"v{i}_{k}") for k in range(len(task.classes))]
    n = sum(v[1:], v[0])
    return n, F.when(n > 1, sum((x * (x - 1) for x in v[1:]), v[0] * (v[0] - 1)) / F.when(n > 1, n * (n - 1)))


def _salted(labels: DataFrame, votes: DataFrame, part_labels: int) -> tuple[DataFrame, list[str], list[str], dict[str, DataFrame]]:
    """labels, the keys they are joined with items and annotators under, and the number of `parts` of those that have
    more than `part_labels` labels. Where there is none, no key is salted."""
    hot = {k: labels.groupBy(k).agg(F.ceil(F.count("*") / part_labels).cast("int").alias("parts")).filter("parts > 1") for k in ("item", "rater")}
    keys, found = {}, {}
    for k, other in (("item", "rater"), ("rater", "item")):
        keys[k] = [k]
        parts = cut(hot[k], "hot")
        if parts.isEmpty():
            continue
        labels = labels.join(parts, k, "left").withColumn(f"_s_{k}", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        keys[k], found[k] = [k, f"_s_{k}"], parts
    return cut(labels, "salted") if found else labels, keys["item"], keys["rater"], found


def _spread(df: DataFrame, key: str, found: dict[str, DataFrame]) -> DataFrame:
    """df (a row per key) once for every salted key its labels have. No key of it is large, so the join with the labels
    builds a hash table per partition and sorts neither side."""
    if key not in found:
        return df
    return df.join(found[key], key, "left").withColumn(f"_s_{key}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def community_models(judgements: DataFrame, tasks: Sequence[Task], inner: int = 5, strength: float = 20.0, pseudo: float = 8.0, tolerance: float = 1e-4, watch: float | None = None, most_rounds: int = 500, part_labels: int = 50_000) -> list[tuple[DataFrame, DataFrame]]:
    """(items, raters) of every task, from `clean_judgements`.

    items: item, n_labels, consensus (the most probable class), confidence, expected (mean class index), agreement
    (share of pairs of judgements that agree, null for one judgement). raters: rater, n_labels, community, reliability
    (correlation of the rater's labels with the consensus, for nominal tasks chance-corrected agreement).

    Passes over the labels go on until no share of a community's matrix moves by `tolerance` in a pass, for every task
    (one that has settled keeps its matrices), or, with `watch`, until two passes have left the set of raters with a
    reliability below it as it was; an error if `most_rounds` do not get there. `inner` updates of the communities in
    each pass; `strength` judgements' worth of prior on each community's matrix; `pseudo` judgements by which a rater's
    own matrix is drawn to its communities'.
    """
    tasks = list(tasks)
    at, c = _columns(tasks), [len(t.classes) for t in tasks]
    votes = item_votes(judgements, tasks)
    labels, item_key, rater_key, found = _salted(judgements, votes, part_labels)
    models, names = [], []
    for t in tasks:
        prior, n = communities(t)
        models.append(_Model(prior, strength, strength * prior, np.ones(len(prior)), pseudo))
        names.append(n)
    items = votes.select("item", *[((F.col(f"v{i}_{k}") + 0.1) / (_votes(i, t)[0] + 0.1 * c[i])).alias(f"q{i}_{k}") for i, t in enumerate(tasks) for k in range(c[i])])
    live, past, stats, flagged, still = [True] * len(tasks), [[] for _ in tasks], None, None, 0
    sums = [F.coalesce(F.sum(F.when(F.col(t.name) == lab, F.col(f"q{i}_{k}"))), F.lit(0.0)).alias(f"n{i}_{k}_{lab}") for i, t in enumerate(tasks) for k in range(c[i]) for lab in range(c[i])]
    for r in range(most_rounds):
        old, before = stats, [m.shares() for m in models]
        stats = cut(labels.join(_spread(items, "item", found).hint("shuffle_hash"), item_key).groupBy("rater").agg(*sums), "raters")
        release(old)
        _fit(stats, tasks, models, inner, live)
        for i, m in enumerate(models):
            if not live[i]:
                continue
            past[i].append(np.log(m.shares()))
            if watch is None and r >= 2 and r % 3 == 0:
                _extrapolate(m, past[i])
            live[i] = float(np.abs(m.shares() - before[i]).max()) >= tolerance
        release_shuffles(labels.sparkSession)
        if watch is not None:
            now = _described(stats, tasks, models, names, 0).filter(F.col("reliability") < watch).agg(F.count("*"), F.bit_xor(F.xxhash64("rater"))).first()
            still, flagged = still + 1 if now == flagged else 0, now
        items = _posterior(labels, stats, tasks, models, item_key, rater_key, found)
        if still >= 2 or not any(live):
            break
    else:
        raise RuntimeError(f"the matrices still move after {most_rounds} passes: {', '.join(t.name for t, on in zip(tasks, live) if on)}")
    done = cut(items.join(votes, "item"), "items")
    out = []
    for i, t in enumerate(tasks):
        n, agree = _votes(i, t)
        probs = F.array(*[F.col(f"q{i}_{k}") for k in range(c[i])])
        classes = F.array(*[F.lit(str(x).lower()) for x in t.classes])
        expected = sum((F.col(f"q{i}_{k}") * k for k in range(c[i])), F.lit(0.0))
        judged = done.filter(n > 0).select("item", n.cast("bigint").alias("n_labels"), F.get(classes, F.array_position(probs, F.array_max(probs)).cast("int") - 1).alias("consensus"), F.array_max(probs).alias("confidence"), expected.alias("expected"), agree.alias("agreement"))
        out.append((judged, _described(stats, tasks, models, names, i)))
    return out


def _described(stats: DataFrame, tasks: Sequence[Task], models: Sequence[_Model], names: Sequence[list[str]], i: int) -> DataFrame:
    """rater, n_labels, community, reliability of one task, of those who gave a label."""
    at, task, model, named = _columns(tasks)[i], tasks[i], models[i], names[i]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                counts = _counts_of(b, at, len(task.classes))
                q = model.membership(counts)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.rint(counts.sum(axis=(1, 2))).astype("int64")), pa.array([named[k] for k in q.argmax(axis=1)]), pa.array(_association(model.own(counts, q), task))], names=["rater", "n_labels", "community", "reliability"])

    return stats.mapInArrow(describe, "rater string, n_labels bigint, community string, reliability double").filter("n_labels > 0")


def _posterior(labels: DataFrame, stats: DataFrame, tasks: Sequence[Task], models: Sequence[_Model], item_key: list[str], rater_key: list[str], found: dict[str, DataFrame]) -> DataFrame:
    """Class probabilities of every item: expected log matrices of its raters, summed, and the class weights."""
    at, c = _columns(tasks), [len(t.classes) for t in tasks]

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = [m.expected()[0] for m in models]
        for b in batches:
            if not b.num_rows:
                continue
            lists = []
            for i, m in enumerate(models):
                e = np.einsum("rm,mcl->rlc", m.membership(_counts_of(b, at[i], c[i])), logs[i]).astype("float32").reshape(-1)
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * c[i] ** 2), pa.array(e)))
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["rater", *(f"e{i}" for i in range(len(tasks)))])

    state = stats.mapInArrow(messages, "rater string, " + ", ".join(f"e{i} array<float>" for i in range(len(tasks))))
    said = labels.join(_spread(state, "rater", found).hint("shuffle_hash"), rater_key)
    sums, exps, shares = [], [], []
    for i, (t, m) in enumerate(zip(tasks, models)):
        w = m.matrix.sum(axis=(0, 2))
        w = np.log(w / w.sum())
        s = [F.col(f"s{i}_{k}") for k in range(c[i])]
        x = [F.col(f"x{i}_{k}") for k in range(c[i])]
        label = F.col(t.name).cast("int") * c[i]
        sums += [(F.coalesce(F.sum(F.get(f"e{i}", label + k).cast("double")), F.lit(0.0)) + float(w[k])).alias(f"s{i}_{k}") for k in range(c[i])]
        exps += [F.exp(v - F.greatest(*s)).alias(f"x{i}_{k}") for k, v in enumerate(s)]
        shares += [(v / sum(x[1:], x[0])).alias(f"q{i}_{k}") for k, v in enumerate(x)]
    return said.groupBy("item").agg(*sums).select("item", *exps).select("item", *shares)


def community_consensus(ratings: DataFrame, task: Task = RATING, judgements: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(items, raters) of one task: `community_models` of the judgements in `ratings`, or of `judgements`, a stored
    result of `clean_judgements`."""
    labels = cut(clean_judgements(ratings, [task]), "labels") if judgements is None else judgements.select("item", "rater", task.name)
    return community_models(labels.filter(F.col(task.name).isNotNull()), [task], **options)[0]


def unrelated_raters(raters: DataFrame, below: float = 0.45) -> DataFrame:
    """Raters whose judgements do not rise with the consensus: reliability under `below`. Severe, mild and imprecise
    raters keep a high correlation; labels unrelated to the consensus give about 0, opposed ones less."""
    return raters.filter(F.col("reliability") < below)


def overall_agreement(judgements: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """A row per task: task, n_items (with a label), n_labels, observed agreement of two labels of the same item (items
    weighing by their labels, those with one label left out), expected agreement by chance from the labels' shares, and
    the chance-corrected coefficient (null where chance explains everything). One pass over the judgements."""
    votes = item_votes(judgements, tasks)
    aggs = []
    for i, t in enumerate(tasks):
        n, agree = _votes(i, t)
        aggs += [F.count_if(n > 0).alias(f"c{i}"), F.sum(n).alias(f"n{i}"), F.sum(agree * n).alias(f"a{i}"), F.sum(F.when(n > 1, n)).alias(f"w{i}"), *[F.sum(f"v{i}_{k}").alias(f"t{i}_{k}") for k in range(len(t.classes))]]
    rows = []
    for i, t in enumerate(tasks):
        total = F.when(F.col(f"n{i}") > 0, F.col(f"n{i}"))
        chance = sum(((F.col(f"t{i}_{k}") / total) * (F.col(f"t{i}_{k}") / total) for k in range(len(t.classes))), F.lit(0.0))
        rows.append(F.struct(F.lit(t.name).alias("task"), F.col(f"c{i}").alias("n_items"), F.coalesce(F.col(f"n{i}"), F.lit(0.0)).cast("bigint").alias("n_labels"), (F.col(f"a{i}") / F.col(f"w{i}")).alias("observed"), chance.alias("expected")))
    out = votes.agg(*aggs).select(F.inline(F.array(*rows)))
    return out.withColumn("coefficient", (F.col("observed") - F.col("expected")) / F.when(F.col("expected") < 1, 1 - F.col("expected")))
