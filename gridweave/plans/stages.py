"""Planning ahead of Catalyst: which steps are needed, which must run again, and how images are cut into tiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """An operator with its parameters; with the neutral ones it does nothing and is left out of the plan."""

    name: str
    apply: Callable[..., DataFrame]
    neutral: dict = field(default_factory=dict)
    fast: bool = True
    bit: int = 0

    def is_neutral(self, params: dict) -> bool:
        return all(params.get(k, v) == v for k, v in self.neutral.items())


def plan(steps: Sequence[Step], params: dict[str, dict], fast: bool = False) -> list[Step]:
    """The steps to run, in order: neutral ones go, and of a fast plan those that are too slow for it."""
    return [s for s in steps if not s.is_neutral(params.get(s.name, {})) and (s.fast or not fast)]


def run(df: DataFrame, steps: Sequence[Step], params: dict[str, dict], fast: bool = False) -> DataFrame:
    for s in plan(steps, params, fast):
        df = s.apply(df, **params.get(s.name, {}))
    return df


def dirty(steps: Sequence[Step], events: Sequence[str], actions: dict[str, int]) -> list[Step]:
    """The steps that must run again: the masks of all events together, from the first step that one of them touches."""
    mask = 0
    for e in events:
        mask |= actions[e]
    first = next((k for k, s in enumerate(steps) if mask & s.bit), len(steps))
    return list(steps[first:])


class Incremental:
    """Keeps each step's result for as long as nothing before it changes. `keep` cuts the lineage, by writing to the shared folder for instance."""

    def __init__(self, steps: Sequence[Step], keep: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.steps, self.keep, self.held = list(steps), keep, {}

    def run(self, df: DataFrame, params: dict[str, dict], events: Sequence[str] = (), actions: dict[str, int] | None = None) -> tuple[DataFrame, list[str]]:
        """The result, and the names of the steps that ran."""
        again = {s.name for s in (dirty(self.steps, events, actions or {}) if self.held else self.steps)}
        ran = []
        for s in self.steps:
            if s.name in again or s.name not in self.held:
                if not s.is_neutral(params.get(s.name, {})):
                    df = self.keep(s.apply(df, **params.get(s.name, {})))
                    ran.append(s.name)
                self.held[s.name] = df
            df = self.held[s.name]
        return df, ran


def overlay(documents: Sequence[dict], base: dict) -> dict:
    """Parameter documents over defaults: a later one holds where it sets a value; nested documents are laid over each other."""
    out = dict(base)
    for d in documents:
        for k, v in d.items():
            out[k] = overlay([v], out.get(k) or {}) if isinstance(v, dict) else out.get(k) if v is None else v
    return out


def tiles(df: DataFrame, tile: int, halo: int) -> DataFrame:
    """(img, ty, tx, y0, x0, y, x, v): each pixel in its tile and in those whose margin it is in.

    A tile's rows are all a stencil needs, so tiles are worked on each by itself. Pixels are copied by arithmetic on
    their place, not by a join with a table of tiles.
    """
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / F.lit(float(tile))), F.floor((F.col(c) + halo) / F.lit(float(tile))))
    out = df.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x"))).where("ty >= 0 AND tx >= 0")
    most = df.groupBy("img").agg(F.max("y").alias("_y"), F.max("x").alias("_x"))
    out = out.join(most, "img").where((F.col("ty") * tile <= F.col("_y")) & (F.col("tx") * tile <= F.col("_x"))).drop("_y", "_x")
    return out.withColumn("y0", F.col("ty") * tile).withColumn("x0", F.col("tx") * tile)


def untile(df: DataFrame, tile: int) -> DataFrame:
    """The pixels of each tile's own area; margins go."""
    return df.where((F.col("y").between(F.col("y0"), F.col("y0") + tile - 1)) & (F.col("x").between(F.col("x0"), F.col("x0") + tile - 1)))
