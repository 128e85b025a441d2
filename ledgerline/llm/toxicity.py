"""Toxic texts by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, unsigned_hash_of_id

GRAM = 4
SLOTS = 1 << 20
MEMBERS = 3
POSITIVES = 2000
UNLABELLED = 6000
FEATURES = 4096
STEPS = 300
MARKS = 50
_SCALE = 0.2
_PENALTY = 1e-5
_RATE = 0.1
# ASCII letters in lower case, other ASCII but digits as a blank, other bytes as they are.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def grams(text: str | None) -> np.ndarray:
    """Slots of all overlapping byte grams of a whole text, words set apart by one blank."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    data = np.frombuffer(b" " + b" ".join(folded.split()) + b" ", np.uint8)
    if len(data) < GRAM:
        return np.zeros(0, np.uint32)
    packed = np.zeros(len(data) - GRAM + 1, np.uint32)
    for j in range(GRAM):
        packed = (packed << np.uint32(8)) | data[j : len(data) - GRAM + 1 + j]
    return (packed * np.uint32(0x9E3779B1)) >> np.uint32(12)


def _rows(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(grams(t)).astype(np.int32) for t in texts]
    empty = [np.zeros(0, np.int32)]
    return np.concatenate(found + empty), np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(positive: pd.Series, unlabelled: pd.Series, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of a linear classifier that minimises the non-negative risk.

    Features are the presence of grams that are significantly more frequent in
    the positives than in the unlabelled texts. The risk with the logistic loss
    is prior * P(loss as positive) + max(0, U(loss as negative) - prior *
    P(loss as negative)): the unlabelled texts hold a share ``prior`` of
    positives, which the last term takes out again. Where that estimate turns
    negative the step goes up it instead, so that the model does not memorise
    the positives.

    ``prior`` is lowered where the texts say so: a gram is at least as frequent
    in the unlabelled texts as prior times its frequency in the positives, and
    for grams that only positives have the ratio is the prior itself. Its median
    over the fifty clearest grams is an upper bound, also where the labelled
    rows aren't a fair sample.
    """
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))
    (p_slot, p_row), (u_slot, u_row) = _rows(positive), _rows(unlabelled)
    p_has, u_has = np.bincount(p_slot, minlength=SLOTS), np.bincount(u_slot, minlength=SLOTS)
    both = (p_has + u_has + 1) / (n_p + n_u + 2)
    lift = (p_has / n_p - u_has / n_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    marks = np.argsort(-lift, kind="stable")[:MARKS]
    marks = marks[lift[marks] > 4]
    if len(marks):
        prior = min(prior, max(1e-3, float(np.median((u_has[marks] / n_u) / (p_has[marks] / n_p)))))
    bias = float(np.log(prior / (1 - prior)))
    slots = np.sort(np.argsort(-lift, kind="stable")[:FEATURES])
    slots = slots[lift[slots] > 4]
    at = np.full(SLOTS, -1, np.int32)
    at[slots] = np.arange(len(slots))
    p_row, p_at = p_row[at[p_slot] >= 0], at[p_slot[at[p_slot] >= 0]]
    u_row, u_at = u_row[at[u_slot] >= 0], at[u_slot[at[u_slot] >= 0]]
    n = len(slots)
    theta = np.append(np.zeros(n), bias)
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z_p = _SCALE * np.bincount(p_row, theta[p_at], n_p) + theta[n]
        z_u = _SCALE * np.bincount(u_row, theta[u_at], n_u) + theta[n]
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        if negative >= 0:
            g_p, g_u = np.full(n_p, -prior / n_p), _sigmoid(z_u) / n_u
        else:
            g_p, g_u = prior * _sigmoid(z_p) / n_p, -_sigmoid(z_u) / n_u
        slope = _SCALE * (np.bincount(p_at, g_p[p_row], n) + np.bincount(u_at, g_u[u_row], n)) + _PENALTY * theta[:n]
        slope = np.append(slope, g_p.sum() + g_u.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta = theta - _RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return slots, theta[:n] * _SCALE, float(theta[n])


def held_out(id: Column) -> Column:
    """Whether a document is kept from learning: a fifth by crc32 of its id; a NULL id always is."""
    return F.coalesce(F.pmod(unsigned_hash_of_id(id), F.lit(5)) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        positives: int = POSITIVES, unlabelled: int = UNLABELLED, members: int = MEMBERS) -> list[tuple]:
    """Train ``members`` classifiers and return their (slots, weights, bias).

    Each member has a task and a bounded sample of its own: at most
    ``positives`` texts with label 1 and ``unlabelled`` texts of any kind, the
    lowest by a hash of id and member. The class prior is the share of label 1
    among the labels. Only rows outside the held-out fifth are looked at. At most
    4,096 weights a member come to the driver. Without positives, labels or
    texts the list is empty.
    """
    known = labels.where(~held_out(F.col(id)) & F.col(label).isNotNull()).groupBy(id).agg(F.max(label).alias("y"))
    row = known.agg(F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("p")).first()
    if not row["n"] or not row["p"]:
        return []
    prior = min(max(row["p"] / row["n"], 1e-4), 1 - 1e-4)
    seen = docs.where(~held_out(F.col(id))).select(F.col(id).alias("id"), F.col(text).alias("text"))
    toxic = seen.select("id").join(known.where("y = 1").select(F.col(id).alias("id")), "id", "left_semi")
    # Ids are drawn first, so that texts of the bounded sample alone are moved.
    chosen = None
    for m in range(members):
        for kind, rows, most in ((1, toxic, positives), (0, seen, unlabelled)):
            ids = rows.select("id").distinct().orderBy(F.xxhash64(F.lit(m), F.lit(kind), "id"), "id").limit(most)
            ids = ids.select(F.lit(m).alias("member"), F.lit(kind).alias("kind"), "id")
            chosen = ids if chosen is None else chosen.union(ids)
    sample = seen.join(F.broadcast(cut(chosen)), "id").dropDuplicates(["member", "kind", "id"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        slots, weights, bias = train(pdf["text"][pdf["kind"] == 1], pdf["text"][pdf["kind"] == 0], prior)
        return pd.DataFrame({"member": [pdf["member"].iloc[0]], "slots": [slots.astype(int).tolist()],
                             "weights": [weights.tolist()], "bias": [bias]})

    models = sample.groupBy("member").applyInPandas(learn, "member int, slots array<int>, weights array<double>, bias double")
    return [(m["slots"], m["weights"], m["bias"]) for m in sorted(models.collect(), key=lambda m: m["member"])]


def scores(models: list[tuple], text: Column) -> Column:
    """Mean probability of the classifiers for a whole text; 0 without a classifier."""
    slots = sorted({s for m in models for s in m[0]})
    place = {s: i for i, s in enumerate(slots)}
    weights = np.zeros((len(slots), len(models)))
    for k, (own, values, _) in enumerate(models):
        weights[[place[s] for s in own], k] = values
    bias, where = np.array([m[2] for m in models]), np.array(slots, np.int64)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = np.full(SLOTS, -1, np.int32)
        at[where] = np.arange(len(where))
        for texts in batches:
            out = np.zeros(len(texts))
            for i, t in enumerate(texts):
                found = at[grams(t)]
                found = np.unique(found[found >= 0])
                out[i] = _sigmoid(weights[found].sum(axis=0) + bias).mean()
            yield pd.Series(out)

    return of(text) if models else F.lit(0.0)


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", **options) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from 0.5).

    The score looks at the text alone. NULL and empty texts get the score of a
    text without features; repeated rows each get theirs; without positive
    labels every score is 0; no rows give no rows. Labels that repeat count
    once, as 1 if any says so. Columns of those three names are replaced.
    """
    models = fit(docs, labels, id, text, label, **options)
    kept = docs.drop("held_out", "score", "predicted")
    out = kept.withColumn("held_out", held_out(F.col(id))).withColumn("score", scores(models, F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
