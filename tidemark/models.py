"""Models: named steps of SQL over other models and tables.

A model reads its inputs as {input}; any input may be replaced by a DataFrame of the caller's, so that the
same steps run over the driver's tables or over a user's own archive. Nothing runs until an action: a model
is a DataFrame whose inputs are DataFrames, and Catalyst sees the whole plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import dialect
from .storage import stored

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
_INPUT = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Model:
    name: str
    sql: str
    public: bool
    digits: int | None  # to which the registered query rounds its doubles
    make: Callable[..., DataFrame] | None = None  # of the DataFrames of reads, where SQL does not say it
    reads: tuple[str, ...] = ()

    def inputs(self) -> list[str]:
        return list(self.reads) if self.make else list(dict.fromkeys(_INPUT.findall(self.sql)))


MODELS: dict[str, Model] = {}

#: Models that many others read. They are written once a session and folder of tables, and read back: a plan that
#: held each of them anew wherever it is read would be planned and run many times over. The archives are among them, for
#: all else derives from them: the tables are read and joined once, and what follows is as large as the archive.
STORED = frozenset(
    "archive_a archive_b archive_span retraining_calendar schedule "
    "triangle build_cases completed_training validity_a process_states process_history historical_scale process_shift long scored history "
    "history_strata harm_strata history_strata_rows harm_strata_rows endpoint_offsets reliability_history episode_curves location_curves task_cells task_profiles task_prototypes episode_steps episode_summaries task_rows task_courses task_vectors edge_components sparse_scales walked task_distance nearest_threshold coherent_pools pool_rows small_pool_fallback donor_matches curve_pairs cluster_memberships harmed width_bands process_profiles donors archive_normalize validity genuine_events process_daily matched reliability_raw revision_profile route_weights training_features quantile_fit".split()
)
_kept: dict[tuple[str, str, str], DataFrame] = {}


def model(name: str, sql: str, public: bool = True, digits: int | None = 6) -> None:
    if name in MODELS:
        raise ValueError(f"there is a model {name} already")
    MODELS[name] = Model(name, sql.strip(), public, digits)


def frame_model(name: str, reads: tuple[str, ...], make: Callable[..., DataFrame], public: bool = True, digits: int | None = 6, sql: str = "") -> None:
    """A model that make gives of the DataFrames of reads. sql: what is the same in SQL, for the oracle."""
    if name in MODELS:
        raise ValueError(f"there is a model {name} already")
    MODELS[name] = Model(name, sql.strip(), public, digits, make, reads)


def run(spark: SparkSession, name: str, sf_dir: str | None = None, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The model's DataFrame. given: DataFrames that stand for models or tables of those names."""
    from . import registry  # noqa: F401  all models are defined once it is imported

    made: dict[str, DataFrame] = dict(given or {})

    def get(n: str) -> DataFrame:
        if n not in made:
            known = (spark.sparkContext.applicationId, sf_dir or "", n)
            if not given and known in _kept:
                made[n] = _kept[known]
            elif n in MODELS:
                inputs = {i: get(i) for i in MODELS[n].inputs()}
                made[n] = MODELS[n].make(*inputs.values()) if MODELS[n].make else spark.sql(dialect.write(MODELS[n].sql, dialect.SPARK), **inputs)
                if n in STORED:
                    made[n] = stored(made[n], n)
                    if not given:
                        _kept[known] = made[n]
            elif n in TABLES and sf_dir:
                made[n] = spark.read.parquet(f"{sf_dir}/{n}.parquet")
            else:
                raise KeyError(f"no model or table {n}")
        return made[n]

    return get(name)


def rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    return df.select(*(F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema))


def in_sql(name: str) -> bool:
    """Whether the model and all that it reads can be said in SQL."""
    return name not in MODELS or bool(MODELS[name].sql) and all(map(in_sql, dict.fromkeys(_INPUT.findall(MODELS[name].sql))))


def oracle(name: str, doubles: list[str] | None = None) -> str:
    """The model as one DuckDB query over the driver's tables."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in MODELS and n not in order:
            for i in dict.fromkeys(_INPUT.findall(MODELS[n].sql)):
                visit(i)
            order.append(n)

    visit(name)
    steps = ",\n".join(f"{n} AS MATERIALIZED (\n{_INPUT.sub(r'\1', dialect.write(MODELS[n].sql, dialect.DUCKDB))}\n)" for n in order)
    digits = MODELS[name].digits
    # COLUMNS(lambda) keeps the order; only doubles are rounded
    last = f"SELECT * FROM {name}" if digits is None or not doubles else f"SELECT * REPLACE ({', '.join(f'round({d}, {digits}) AS {d}' for d in doubles)}) FROM {name}"
    return f"WITH {steps}\n{last}"
