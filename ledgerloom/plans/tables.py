"""Tables by name, and plans cut where their rows are needed more than once."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, kept in the folder that ``spark.checkpoint.dir`` names, with no lineage behind them."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return df.checkpoint()


@dataclass
class Relations:
    """Declared relations, each built from those that it names, once, when first asked for."""

    builders: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = field(default_factory=dict)
    built: dict[str, DataFrame] = field(default_factory=dict)

    def declare(self, name: str, build: Callable[..., DataFrame], *needs: str) -> None:
        """``build`` is called with the relations it needs, in that order."""
        if name in self.builders:
            raise ValueError(f"relation '{name}' is already declared")
        self.builders[name] = (needs, build)

    def order(self, name: str) -> list[str]:
        """What must be built for ``name``, itself last; unknown names and cycles are refused before anything is built."""
        out: list[str] = []

        def visit(one: str, above: tuple[str, ...]) -> None:
            if one in above:
                raise ValueError(f"relations need each other: {' -> '.join((*above[above.index(one):], one))}")
            if one not in self.builders:
                raise ValueError(f"unknown relation '{one}'; known: {', '.join(sorted(self.builders))}")
            if one not in out:
                for need in self.builders[one][0]:
                    visit(need, (*above, one))
                out.append(one)

        visit(name, ())
        return out

    def get(self, name: str) -> DataFrame:
        for one in self.order(name):
            if one not in self.built:
                needs, build = self.builders[one]
                self.built[one] = build(*[self.built[n] for n in needs])
        return self.built[name]

    def views(self, spark: SparkSession, *names: str, prefix: str = "") -> list[str]:
        """Temporary views of the relations and of all they need, in the order of their needs."""
        wanted = list(dict.fromkeys(one for name in names or self.builders for one in self.order(name)))
        for one in wanted:
            self.get(one).createOrReplaceTempView(prefix + one)
        return [prefix + one for one in wanted]
