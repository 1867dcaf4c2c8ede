"""Merging clouds and replaying an edit log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import in_polygon, prism_mask, screen_columns, sphere_mask, visible
from .transform import apply_affine

HISTORY: int | None = None      # changes that can be undone; the editor's own depth of 30 is for callers who ask for it


def merge_clouds(points: DataFrame, slots: DataFrame) -> DataFrame:
    """All points of the visible slots; intensity survives only if every part has it.

    ``slots``: cloud_id, slot, visible. Rows keep (slot, point_id), which is the
    order a writer sorts by. Raises when no visible slot has points.
    """
    shown = slots.where("visible").select("cloud_id", "slot")
    # one row per slot of the editor
    parts = points.join(F.broadcast(shown), "cloud_id")
    gate = parts.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("intensity").isNotNull()).alias("all_i")).first()
    if not gate["n"]:
        raise ValueError("no visible slot with points")
    intensity = F.col("intensity") if gate["all_i"] else F.lit(None).cast("double")
    return parts.withColumn("intensity", intensity)


def append_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """b after a; intensity is dropped unless both have it."""
    both = "intensity" in a.columns and "intensity" in b.columns
    base = [c for c in a.columns if c != "intensity" and c in b.columns]
    cols = [*base, "intensity"] if both else base
    return a.select(*cols).unionByName(b.select(*cols))


def union_models(a: DataFrame, b: DataFrame, offset: int = 1_000_000, key: str = "pid") -> DataFrame:
    """Two models in one table, the second with its ids moved up: by ``offset``, or further where the first has higher ids."""
    highest = a.agg(F.max(key)).first()[0]
    offset = max(offset, 0 if highest is None else highest + 1)
    return a.unionByName(b.withColumn(key, F.col(key) + F.lit(offset)), allowMissingColumns=True)


def intersect_names(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


@dataclass(frozen=True)
class Edit:
    """One step of the log. Selections set the mask; delete, brush and move change
    points and can be undone; undo and redo walk the history."""

    op: str
    params: tuple = ()


SELECTIONS = ("box", "lasso", "prism", "sphere", "all", "invert", "clear")


def _mask(edit: Edit, before: Column) -> Column:
    p = edit.params
    if edit.op in ("box", "lasso"):
        mvp, width, height, shape = p
        sx, sy, depth = screen_columns(mvp, width, height)
        ok = F.coalesce(depth.between(F.lit(-1.0), F.lit(1.0)), F.lit(False))
        if edit.op == "lasso":
            return ok & in_polygon(sx, sy, shape)
        return ok & sx.between(shape[0], shape[2]) & sy.between(shape[1], shape[3])
    if edit.op == "prism":
        return prism_mask(*p)
    if edit.op == "sphere":
        return sphere_mask(*p)
    if edit.op == "all":
        return F.lit(True)
    return ~before if edit.op == "invert" else F.lit(False)


def _apply(df: DataFrame, steps: tuple[Edit, ...]) -> DataFrame:
    """The cloud after the given steps, as one plan of filters and projections."""
    df = df.withColumn("selected", F.lit(False))
    for e in steps:
        if e.op in SELECTIONS:
            df = df.withColumn("selected", _mask(e, F.col("selected")) & visible(df))
        elif e.op == "delete":
            df = df.where(~F.col("selected")).withColumn("selected", F.lit(False))
        elif e.op == "brush":
            df = df.where(~(sphere_mask(*e.params) & visible(df))).withColumn("selected", F.lit(False))
        elif e.op == "move":
            df = apply_affine(df, *e.params).withColumn("selected", F.lit(False))
        else:
            raise ValueError(f"unknown edit {e.op!r}")
    return df


def _walk(log: list[Edit], limit: int | None, met: dict[int, bool]) -> tuple[tuple[Edit, ...], list[tuple[int, tuple[Edit, ...]]]]:
    """Steps left at the end of the log, and for every delete and brush the steps before it with what it would remove
    selected. ``met`` tells by place in the log whether it removes anything; what is not known yet is taken as true."""
    done: tuple[Edit, ...] = ()
    undo: list[tuple[Edit, ...]] = []
    redo: list[tuple[Edit, ...]] = []
    pending: tuple[Edit, ...] = ()
    asked = []
    for i, e in enumerate(log):
        if e.op in SELECTIONS:
            pending = (*pending, e)
        elif e.op == "undo":
            if undo:
                redo.append(done)
                done, pending = undo.pop(), ()
        elif e.op == "redo":
            if redo:
                undo.append(done)
                done, pending = redo.pop(), ()
        else:
            if e.op in ("delete", "brush"):
                asked.append((i, (*done, *((Edit("sphere", e.params),) if e.op == "brush" else pending))))
                if not met.get(i, True):
                    continue
            undo = [*undo, done] if limit is None else [*undo, done][-limit:]
            redo.clear()
            done, pending = (*done, *(pending if e.op == "delete" else ()), e), ()
    return (*done, *pending), asked


def _shared(a: tuple, b: tuple) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x is not y), min(len(a), len(b)))


def _names(steps: tuple[Edit, ...]) -> tuple[int, ...]:
    """Steps by identity: lists of one log share their steps, and parameters need no hash."""
    return tuple(map(id, steps))


def selects_any(df: DataFrame, asked: list[tuple[Edit, ...]]) -> list[bool]:
    """Whether a point that is left is selected after each of the given step lists; one scan for all of them.

    Points carry their place, whether they are left and whether they are selected through the steps. Where a list
    leaves the one before it, as after an undo, the state at that fork is kept beside and taken up again."""
    state = ["x", "y", "z", "_left", "selected"]
    df = df.select("x", "y", "z", *(["visible"] if "visible" in df.columns else []), F.lit(True).alias("_left"), F.lit(False).alias("selected"))
    forks = {_names(b[:_shared(a, b)]) for a, b in zip(asked, asked[1:])} | {()}
    kept: dict[tuple[int, ...], int] = {}
    here: tuple[int, ...] = ()

    def keep(df: DataFrame) -> DataFrame:
        if here not in forks or here in kept:
            return df
        kept[here] = len(kept)
        return df.withColumns({f"{c}_{kept[here]}": F.col(c) for c in state})

    df = keep(df)
    for n, steps in enumerate(asked):
        path = _names(steps)
        if path[:len(here)] != here:
            here = max((k for k in kept if path[:len(k)] == k), key=len)
            df = df.withColumns({c: F.col(f"{c}_{kept[here]}") for c in state})
        for e in steps[len(here):]:
            if e.op in SELECTIONS:
                df = df.withColumn("selected", _mask(e, F.col("selected")) & visible(df))
            elif e.op == "move":
                df = apply_affine(df, *e.params).withColumn("selected", F.lit(False))
            elif e.op in ("delete", "brush"):
                gone = F.col("selected") if e.op == "delete" else sphere_mask(*e.params) & visible(df)
                df = df.withColumns({"_left": F.coalesce(F.col("_left") & ~gone, F.lit(False)), "selected": F.lit(False)})
            else:
                raise ValueError(f"unknown edit {e.op!r}")
            here = (*here, id(e))
            df = keep(df)
        df = df.withColumn(f"met_{n}", F.col("_left") & F.col("selected"))
    return list(df.agg(*[F.coalesce(F.bool_or(f"met_{n}"), F.lit(False)) for n in range(len(asked))]).first()) if asked else []


def effective_steps(df: DataFrame, log: list[Edit], limit: int | None = HISTORY) -> tuple[Edit, ...]:
    """Steps left after undo and redo.

    A new change clears what could be redone, all changes (or the last ``limit``) can be
    undone, and a delete that meets no point is no change. One scan of the cloud answers that for all deletes of the
    log, on the guess that each meets a point. An empty delete changes no point, so the answers up to the next undo or
    redo (or up to an empty brush, which leaves a selection standing) hold even where the guess was wrong; only
    what comes after is asked again.
    """
    met: dict[int, bool] = {}
    turns = [i for i, e in enumerate(log) if e.op in ("undo", "redo")]
    while True:
        steps, asked = _walk(log, limit, met)
        open_ = [(i, s) for i, s in asked if i not in met]
        if not open_:
            return steps
        holds = len(log)                # answers for places up to here are sure
        for (i, _), found in zip(open_, selects_any(df, [s for _, s in open_])):
            if i > holds:
                break
            met[i] = found
            if not found:
                holds = min(holds, i if log[i].op == "brush" else next((t for t in turns if t > i), len(log)))


def replay(df: DataFrame, log: list[Edit], limit: int | None = HISTORY) -> DataFrame:
    """The cloud after the whole log, with the selection that is left at its end."""
    return _apply(df, effective_steps(df, log, limit))


def read_log(edits: DataFrame) -> list[Edit]:
    """Edit table (seq, op, params JSON array) -> list; a log holds one row per user action."""
    import json

    def freeze(v):
        return tuple(freeze(i) for i in v) if isinstance(v, list) else v

    return [Edit(r["op"], freeze(json.loads(r["params"] or "[]"))) for r in edits.orderBy("seq").toLocalIterator()]
