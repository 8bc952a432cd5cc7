"""The analysis as one lazily built set of frames.

Ingest (names, empties, dates, ids) -> key normalisation -> rep/team lookup
-> label unification (``v1``) -> entry-stage imputation (``v2``) -> stage
medians -> median imputation (``imputed``) -> outcome and cycle (``closed``).
Which frame a metric reads matters: the null profile and missing-by-stage
read ``v1``; the price table, column profile and histogram read ``v2``;
everything else reads ``closed``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.functions.names import clean_names
from dealflow.functions.scalars import DEFAULT_DATE_ORDERS, parse_date_columns, replace_all, to_date_column
from dealflow.operators.columns import across_contains, names_containing, relocate
from dealflow.operators.filters import require_none, where_missing
from dealflow.operators.impute import group_median_lag, impute_by_group_median, impute_entry_stage
from dealflow.operators.joins import lookup_join
from dealflow.operators.metrics import closed_stages, deal_outcome, sales_cycle
from dealflow.operators.ordering import read_order_id, row_id
from dealflow.session import remove_path, shared_path
from dealflow.sources import io, testdata

# The raw team label merged into the canonical one.
RAW_TEAM_LABEL, TEAM_LABEL = "TEAM SMB", "SMB"


def ingest(df: DataFrame, date_orders: Sequence[str] = DEFAULT_DATE_ORDERS,
           id_col: str = "id", id_order: Sequence[str] | None = None,
           drop_empty: bool | str = True, types: dict[str, str] | None = None) -> DataFrame:
    """Clean names, apply declared types, drop empty rows/columns, type date
    columns, ensure an id (dense, 1-based; in ``id_order`` if given, else in
    the order rows are read, i.e. file order for a single file).

    ``types`` maps cleaned column names to Spark types for text sources;
    values that do not convert become NULL. ``drop_empty="rows"`` drops
    all-NULL rows only (lazily) and leaves the column check to a later pass
    over stored data (see ``materialize``).
    """
    df = clean_names(df)
    for c, t in (types or {}).items():
        if c in df.columns and df.schema[c].dataType.simpleString() != t:
            df = df.withColumn(c, F.col(c).try_cast(t))
    if drop_empty == "rows":
        df = io.remove_empty(df, rows=True, cols=False)
    elif drop_empty:
        df = io.remove_empty(df)
    dates = names_containing(df, "date")
    texts = [c for c in dates if isinstance(df.schema[c].dataType, T.StringType)]
    df = parse_date_columns(df, {c: c for c in texts}, date_orders) if texts else df
    for c in dates:
        if c not in texts:
            df = df.withColumn(c, to_date_column(df, c, date_orders))
    if id_col not in df.columns:
        if id_order:
            df = row_id(df, list(id_order), id_col)
        else:
            df = read_order_id(df, id_col)
    return relocate(df, id_col, before=1)


def ingest_rep_team(df: DataFrame, key: str = "sales_rep", drop_empty: bool = True) -> DataFrame:
    df = clean_names(df)
    if drop_empty:
        df = io.remove_empty(df)
    return across_contains(df, key, lambda c: replace_all(c, " ", "_"))


def _written(df: DataFrame, path: str, drop_empty_of: Sequence[str] = (),
             sort_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read back, without the columns of
    ``drop_empty_of`` that are NULL everywhere (counted during the write)."""
    schema = df.schema
    check = [c for c in drop_empty_of if c in schema.names]
    observed = None
    if check:
        observed = Observation("non_null_counts")
        df = df.observe(observed, *[F.count(F.col(c)).alias(c) for c in check])
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(schema).parquet(path).select(*schema.names)
    if observed is not None:
        filled = observed.get
        stored = stored.drop(*[c for c in check if filled[c] == 0])
    return stored


class SalesAnalysis:
    """Frames of the analysis, built lazily from the two ingested inputs."""

    def __init__(self, opportunities: DataFrame, rep_team: DataFrame,
                 owner: str = "opportunity_owner", rep: str = "sales_rep",
                 team: str = "team", stage: str = "stage",
                 created: str = "created_date", changed: str = "last_stage_change_date"):
        self.opportunities = opportunities
        self.rep_team = rep_team
        self.owner, self.rep, self.team = owner, rep, team
        self.stage, self.created, self.changed = stage, created, changed
        self._v1: DataFrame | None = None
        self._path: str | None = None
        self._store_v1 = False

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> SalesAnalysis:
        """Scan and joins run once: the cleaned opportunities are written at once,
        ``v1`` when first asked for, and every pass of a query reads the tables."""
        cleaned = io.remove_empty(clean_names(testdata.opportunities(spark, sf_dir)), cols=False)
        stored = _written(cleaned, shared_path(spark, "opportunities"), cleaned.columns)
        reps = ingest_rep_team(testdata.sales_rep_team(spark, sf_dir))
        a = cls(ingest(stored, drop_empty=False), reps)
        a._store_v1 = True
        return a

    @cached_property
    def joined(self) -> DataFrame:
        p = across_contains(self.opportunities, [self.owner, "company"],
                            lambda c: replace_all(c, " ", "_"))
        j = lookup_join(p, self.rep_team, self.owner, self.rep, how="left")
        return relocate(j, self.team, after=self.owner)

    @property
    def v1(self) -> DataFrame:
        if self._v1 is None:
            self._v1 = across_contains(self.joined, self.team,
                                       lambda c: replace_all(c, RAW_TEAM_LABEL, TEAM_LABEL))
            if self._store_v1:
                self._v1 = _written(self._v1, shared_path(self._v1.sparkSession, "v1"))
        return self._v1

    def materialize(self, path: str | None = None,
                    drop_empty_of: Sequence[str] = (),
                    sort_by: Sequence[str] = ()) -> SalesAnalysis:
        """Write ``v1`` once as Parquet in the shared folder; every later frame
        reads it (with column pruning) instead of re-running scan and joins.

        ``sort_by``: label columns (the pipeline stage) that each file's rows are
        ordered by, so that filters on them skip row groups and pages; values
        are stored as they are (partition folders would turn '' into NULL).

        ``drop_empty_of``: input columns whose emptiness was not checked at
        ingest; their non-NULL counts are observed during the write itself
        (no extra pass over input or output) and columns that are NULL
        everywhere are dropped.
        """
        path = path or shared_path(self.v1.sparkSession, "v1")
        self._v1 = _written(self.v1, path, drop_empty_of, sort_by)
        self._path = path
        self.reset()
        return self

    def reset(self) -> None:
        """Forget derived frames, so that the next use computes them anew."""
        for k in ("v2", "stage_medians", "imputed", "closed", "closed_deals", "closed_outcomes"):
            self.__dict__.pop(k, None)

    def require_complete(self) -> SalesAnalysis:
        """The data-quality gate: raise if imputation left a change date missing."""
        require_none(where_missing(self.imputed, self.changed), "deals without a stage change date")
        return self

    def commit_imputed(self, path: str | None = None) -> SalesAnalysis:
        """Write the imputed table once, with the data-quality gate inside the
        writing job: if a change date is still missing it raises and leaves no
        table. Later frames read what was written."""
        imputed = self.imputed
        path = path or shared_path(imputed.sparkSession, "imputed")
        io.write_checked(imputed, path, F.col(self.changed).isNull(), "deals without a stage change date")
        stored = imputed.sparkSession.read.schema(imputed.schema).parquet(path).select(*imputed.columns)
        for k in ("closed", "closed_deals"):
            self.__dict__.pop(k, None)
        self.__dict__["imputed"] = stored
        return self

    @cached_property
    def v2(self) -> DataFrame:
        return impute_entry_stage(self.v1, self.changed, self.created, self.stage)

    @cached_property
    def stage_medians(self) -> DataFrame:
        return group_median_lag(self.v2, self.stage, self.created, self.changed)

    @cached_property
    def imputed(self) -> DataFrame:
        return impute_by_group_median(self.v2, self.stage_medians, self.stage,
                                      self.changed, self.created)

    @cached_property
    def closed(self) -> DataFrame:
        return sales_cycle(deal_outcome(self.imputed, self.stage), self.created, self.changed)

    @cached_property
    def closed_deals(self) -> DataFrame:
        """Won and lost deals only, selected on the stored stage column so the
        predicate reaches the Parquet scan."""
        return closed_stages(self.closed, self.stage)

    @cached_property
    def closed_outcomes(self) -> DataFrame:
        """Won and lost deals straight from ``v1``, for metrics that use no
        dates: the same rows, without the imputation."""
        return deal_outcome(closed_stages(self.v1, self.stage), self.stage)


_PREPARED: dict[tuple[str, str], SalesAnalysis] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir.rstrip("/")


def analysis(spark: SparkSession, sf_dir: str) -> SalesAnalysis:
    """The analysis over a test folder: the prepared (written) one if
    ``prepare`` ran in this session, else one over tables written for it."""
    found = _PREPARED.get(_key(spark, sf_dir))
    return found if found is not None else SalesAnalysis.from_testdata(spark, sf_dir)


def prepare(spark: SparkSession, sf_dir: str, path: str | None = None) -> SalesAnalysis:
    """Ingest, join and clean once, write ``v1`` to the shared folder, and let
    later ``analysis`` calls in this session start from it."""
    opps = ingest(testdata.opportunities(spark, sf_dir), drop_empty="rows")
    reps = ingest_rep_team(testdata.sales_rep_team(spark, sf_dir))
    a = SalesAnalysis(opps, reps).materialize(path, drop_empty_of=opps.columns,
                                              sort_by=["stage"])
    _PREPARED[_key(spark, sf_dir)] = a
    return a


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Drop a prepared analysis and delete its table."""
    found = _PREPARED.pop(_key(spark, sf_dir), None)
    if found is not None and found._path:
        remove_path(spark, found._path)


__all__ = ["SalesAnalysis", "analysis", "forget", "ingest", "ingest_rep_team", "prepare"]
