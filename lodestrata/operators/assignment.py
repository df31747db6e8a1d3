"""Sequential decisions: group-aware splits with a seed, and one-to-one matching of boxes.

Both depend on the order of earlier decisions, so each trial or image is one task; trials and
images run side by side. Random draws are CPython's, which makes a seed mean the same everywhere.
"""

from __future__ import annotations

import random
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.boxes import overlapping
from lodestrata.session import ship

SPLITS = ("train", "val", "test")
_AT_ONCE = 4_096  # groups that are Python objects at a time


class _Tally:
    """Running totals of each split, and the share errors that a further group would leave."""

    def __init__(self, totals: dict[str, float], target: tuple[float, ...]):
        self.totals, self.target = totals, target
        self.have = [dict.fromkeys(totals, 0) for _ in target]

    def error(self, key: str, at: int, more: dict) -> float:
        whole = self.totals[key]
        if not whole:
            return 0.0
        return sum(abs((have[key] + (more[key] if k == at else 0)) / whole - goal) for k, (have, goal) in enumerate(zip(self.have, self.target, strict=True)))

    def add(self, at: int, more: dict) -> None:
        for key in self.totals:
            self.have[at][key] += more[key]


def greedy_split(groups: list[dict], classes: list[str], target: tuple[float, ...], seed: int, lexicographic: bool) -> dict:
    """Split of each group, the largest first. ``groups``: id, images, multi and a count for each class.

    ``lexicographic``: image, class, multi-class and group error compared in that order, ties to the
    first split. Else one weighted sum (1, 1/3 for each class, 1/2, 1/4), ties by the seed's generator.
    """
    columns = {k: np.array([g[k] for g in groups], np.int64) for k in ("images", "multi", *classes)}
    ids = [g["id"] for g in groups]
    order, splits = greedy_columns(sorted(range(len(ids)), key=ids.__getitem__), columns, classes, target, seed, lexicographic)
    return {ids[k]: SPLITS[at] for k, at in zip(order.tolist(), splits.tolist(), strict=True)}


def greedy_columns(by_id, columns: dict[str, np.ndarray], classes: list[str], target: tuple[float, ...], seed: int, lexicographic: bool) -> tuple[np.ndarray, np.ndarray]:
    """(group, split) in the order of placing, as numbers: groups are columns of integers, of which few at a time are Python objects.

    ``by_id``: the groups in the order of their ids.
    """
    n, keys = len(by_id), ["images", "groups", "multi", *classes]
    tally = _Tally({k: n if k == "groups" else int(columns[k].sum()) for k in keys}, target)
    draw = random.Random(seed)
    order = array("q", by_id)
    draw.shuffle(order)
    order = np.frombuffer(order, np.int64) if n else np.zeros(0, np.int64)
    order = order[np.argsort(-columns["images"][order], kind="stable")]
    splits = np.zeros(n, np.int8)
    for place in range(n):
        if place % _AT_ONCE == 0:
            some = {c: v[order[place : place + _AT_ONCE]].tolist() for c, v in columns.items()}
        g = {"groups": 1} | {c: v[place % _AT_ONCE] for c, v in some.items()}
        ranks = []
        for at in range(len(target)):
            image, group, multi = (tally.error(key, at, g) for key in ("images", "groups", "multi"))
            by_class = sum(tally.error(c, at, g) for c in classes) / len(classes)
            ranks.append(tuple(round(x, 12) for x in (image, by_class, multi, group)) if lexicographic else image + by_class + 0.5 * multi + 0.25 * group)
        best = min(ranks)
        at = ranks.index(best) if lexicographic else draw.choice([j for j, x in enumerate(ranks) if abs(x - best) < 1e-12])
        tally.add(at, g)
        splits[place] = at
    return order, splits


def split_trials(groups: DataFrame, classes: list[str], trials: list[tuple[int, tuple[float, ...]]], lexicographic: bool = True) -> DataFrame:
    """(trial, seed, id, split) for every (seed, target) of ``trials``: one task each, with the whole group table.

    ``groups`` (id, images, multi, one column for each class) is read by every trial, so it has to fit one task.
    """
    ship(groups.sparkSession)
    kind = groups.schema["id"].dataType.simpleString()
    settings = list(enumerate(trials))
    numbered = groups.withColumn("trial", F.explode(F.array(*(F.lit(k) for k, _ in settings))))

    def run(key, pdf):
        trial = int(key[0])
        seed, target = trials[trial]
        columns = {k: pdf[k].to_numpy(np.int64) for k in ("images", "multi", *classes)}
        ids = pdf["id"].to_numpy()
        order, splits = greedy_columns(np.argsort(ids, kind="stable"), columns, classes, target, seed, lexicographic)
        return pd.DataFrame({"trial": np.full(len(ids), trial, np.int32), "seed": str(seed), "id": ids[order], "split": np.array(SPLITS, object)[splits]})

    return numbered.groupBy("trial").applyInPandas(run, f"trial int, seed string, id {kind}, split string")


def match_boxes(truth: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class-independent one-to-one matches of each image: highest IoU, then confidence, then ids as text.

    ``truth``: image_id, id, cls, box. ``predicted``: also confidence. Result: image_id, kind (matched, missed
    or false_positive), gt_id, pred_id, gt_class, pred_class, confidence, box_iou. Overlaps are found by
    cells in the JVM; a task sees the overlapping pairs of one image only. Ids are unique within an image.
    """
    t = truth.select("image_id", F.col("id").alias("gt_id"), F.col("cls").cast("int").alias("gt_class"), F.col("box").alias("gt_box"))
    p = predicted.select("image_id", F.col("id").alias("pred_id"), F.col("cls").cast("int").alias("pred_class"), F.col("confidence").cast("double").alias("confidence"), F.col("box").alias("pred_box"))
    near = overlapping(t, p, "image_id", "gt_box", "pred_box", threshold).select("l.image_id", "l.gt_id", "r.pred_id", "r.confidence", F.col("overlap").alias("box_iou"))
    near = near.withColumns({"gt_text": F.col("gt_id").cast("string"), "pred_text": F.col("pred_id").cast("string")})

    def settle(image: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values(["box_iou", "confidence", "gt_text", "pred_text"], ascending=[False, False, True, True])
        (gt, _), (pred, _) = pd.factorize(image["gt_text"]), pd.factorize(image["pred_text"])
        free_gt, free_pred = np.ones(len(image), bool), np.ones(len(image), bool)
        won = np.zeros(len(image), bool)
        for k, (i, j) in enumerate(zip(gt, pred, strict=True)):
            if free_gt[i] and free_pred[j]:
                won[k], free_gt[i], free_pred[j] = True, False, False
        return image.loc[won, ["image_id", "gt_id", "pred_id", "box_iou"]]

    types = {f.name: f.dataType.simpleString() for f in near.schema.fields}
    won = near.groupBy("image_id").applyInPandas(settle, ", ".join(f"{c} {types[c]}" for c in ("image_id", "gt_id", "pred_id", "box_iou")))
    left = t.drop("gt_box").join(won, ["image_id", "gt_id"], "left")
    full = left.join(p.drop("pred_box"), ["image_id", "pred_id"], "full_outer")
    kind = F.when(F.col("gt_id").isNull(), "false_positive").when(F.col("pred_id").isNull(), "missed").otherwise("matched")
    return full.select("image_id", kind.alias("kind"), "gt_id", "pred_id", "gt_class", "pred_class", "confidence", "box_iou")


def match_by_class(truth: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predictions in their order, each to the free box of its class with most overlap (the last of equals): hit, false_positive or ignored.

    ``truth``: image_id, id, cls, box, ignore. ``predicted``: image_id, id, cls, box, ordinal. Ignored boxes have no class and are asked only
    if no free box reaches the threshold: a prediction that overlaps one of them by the threshold or more counts neither way, and an ignored box is never
    used up. Result: image_id, pred_id, gt_id (of the ignored box with most overlap, where one decided), outcome.
    """
    t = truth.select("image_id", F.col("id").alias("gt_id"), F.col("cls").alias("gt_cls"), F.col("box").alias("gt_box"), F.coalesce("ignore", F.lit(False)).alias("ignore"))
    p = predicted.select("image_id", F.col("id").alias("pred_id"), "cls", F.col("box").alias("pred_box"), "ordinal")
    found = overlapping(p, t, "image_id", "pred_box", "gt_box", threshold, where="r.ignore OR l.cls = r.gt_cls").select("l.image_id", "l.pred_id", "r.gt_id", "r.ignore", "overlap")
    near = p.select("image_id", "ordinal", "pred_id").join(found, ["image_id", "pred_id"], "left").withColumn("ignore", F.coalesce("ignore", F.lit(False)))
    types = {f.name: f.dataType.simpleString() for f in near.schema.fields}

    names = ("image_id", "ordinal", "pred_id", "gt_id", "ignore", "overlap")

    def settle(options: list[tuple], out: list[tuple]) -> None:
        options = [o for o in options if o[1] is not None and o[2] is not None]
        options.sort(key=lambda o: (o[3] is not None, o[3]), reverse=True)
        options.sort(key=lambda o: -1.0 if o[5] is None else o[5], reverse=True)
        options.sort(key=lambda o: o[1])
        used, of = set(), {}
        for o in options:
            of.setdefault((o[1], o[2]), []).append(o)
        for (_, pred), found in of.items():
            free = next((o[3] for o in found if o[3] is not None and not o[4] and o[3] not in used), None)
            apart = next((o[3] for o in found if o[3] is not None and o[4]), None)
            if free is not None:
                used.add(free)
            out.append((found[0][0], pred, free if free is not None else apart, "hit" if free is not None else "ignored" if apart is not None else "false_positive"))

    fields = [("image_id", types["image_id"]), ("pred_id", types["pred_id"]), ("gt_id", types["gt_id"]), ("outcome", "string")]

    def run(batches):
        held, out, schema = [], [], None
        for batch in batches:
            at = {c: batch.schema.field(c).type for c in names}
            schema = pa.schema([pa.field(c, at.get(c, pa.string())) for c, _ in fields])
            for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if held and row[0] != held[0][0]:
                    settle(held, out)
                    held = []
                held.append(row)
            if len(out) >= 1 << 13:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if held:
            settle(held, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return near.select(*names).repartition("image_id").sortWithinPartitions("image_id").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in fields))


def failure_category(matches: DataFrame, poor_mask: float = 0.5) -> DataFrame:
    """Adds ``category``: missed, false positive, severe, adjacent, poor localisation, or empty; the first that applies.

    Localisation is judged by ``mask_iou`` where the matches have it (see ``masks.overlaps``), else by the boxes.
    """
    overlap = F.col("mask_iou" if "mask_iou" in matches.columns else "box_iou")
    apart = F.abs(F.col("gt_class") - F.col("pred_class"))
    return matches.withColumn(
        "category",
        F.when(F.col("kind") == "missed", "F1 missed")
        .when(F.col("kind") == "false_positive", "F2 false positive")
        .when(apart == 2, "F4 severe")
        .when(apart == 1, "F3 adjacent")
        .when(overlap < poor_mask, "F5 poor localisation")
        .otherwise(""),
    )
