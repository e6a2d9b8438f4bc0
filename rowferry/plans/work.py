"""Works: source -> lookups -> where -> merge branch -> assignments -> target.

A ``Work`` is a description. ``plan`` turns it into lazy frames over the tables
at hand; ``run_works`` runs several in order, staging each so that later works
see what earlier ones wrote.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from rowferry.errors import ConfigError
from rowferry.functions.exprs import Col, Expr, Scope, as_const
from rowferry.functions.generators import JobClock
from rowferry.functions.predicates import Condition, comparable
from rowferry.operators.lookup import (
    Lookup,
    attach_lookup,
    equality_pairs,
    last_per_key,
    lookup_duplicates,
    order_key,
)
from rowferry.operators.mapping import (
    FAILURE_TYPE,
    convert_columns,
    first_failure,
    good_rows,
    reject_rows,
)
from rowferry.operators.merge import (
    apply_deletes,
    apply_inserts,
    apply_updates,
    distinct_keys,
    first_wins,
    mark_matches,
)
from rowferry.operators.numbering import with_row_no
from rowferry.plans.result import JobResult, WorkCounts
from rowferry.scratch import materialize
from rowferry.sources.versions import Manifest, VersionedTable
from rowferry.types import (
    Kind,
    Value,
    kind_of,
    normalize_types,
    quoted,
    resolve_name,
    values_of,
)

ROW, FAIL, MATCH, ACTION, HIT = "__row", "__fail", "__match", "__action", "__hit"

#: A table may be a frame, or a versioned table that works write.
Tables = dict[str, DataFrame | VersionedTable]


@dataclass
class _LookupSpec:
    table: DataFrame | str
    alias: str
    on: list[tuple[Expr, str]]
    how: str
    order_by: list[str]


class Work:
    """Builder of one unit of work; every method returns the work itself."""

    def __init__(self, name: str):
        self.name = name
        self._source: DataFrame | str | None = None
        self.alias = "source"
        self._order: list[str] = []
        self._row: str | None = None
        self._first_row = 1
        self._lookups: list[_LookupSpec] = []
        self._where: Condition | None = None
        self.target: str | None = None
        self.target_alias = "target"
        self._on: list[tuple[Expr, str]] = []
        self._match = "normalized"
        self._insert: dict[str, Expr] | None = None
        self._update: dict[str, Expr] | None = None
        self._delete = False
        self._actions: list[str] = []

    # --- clauses ---------------------------------------------------------

    def source(
        self,
        table: DataFrame | str,
        alias: str = "source",
        order_by: str | list[str] = (),
        row: str | None = None,
        first_row: int = 1,
    ) -> "Work":
        """Main rows. ``order_by`` is a unique order; ``row`` names a column that already
        holds row numbers, otherwise rejects are numbered from ``first_row`` in that order."""
        self._source, self.alias = table, alias
        self._order = [order_by] if isinstance(order_by, str) else list(order_by)
        self._row, self._first_row = row, first_row
        return self

    def lookup(
        self,
        table: DataFrame | str,
        alias: str,
        on: Any,
        how: str = "inner",
        order_by: str | list[str] = (),
    ) -> "Work":
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        self._lookups.append(_LookupSpec(table, alias, equality_pairs(on, alias), how, order))
        return self

    def where(self, condition: Condition) -> "Work":
        self._where = condition
        return self

    def into(self, table: str, alias: str = "target") -> "Work":
        self.target, self.target_alias = table, alias
        return self

    def on(self, pairs: Any, match: str = "normalized") -> "Work":
        """Merge key. Updates and deletes then hit rows with an equal match key, or
        (``match="exact"``) only rows that store exactly the converted key."""
        if match not in ("normalized", "exact"):
            raise ConfigError(f"match must be normalized or exact, not {match}")
        self._on, self._match = equality_pairs(pairs, self.target_alias), match
        return self

    def add(self, assignments: dict[str, Any]) -> "Work":
        self._actions.append("add")
        self._insert = _assignments(assignments)
        return self

    def not_matched_add(self, assignments: dict[str, Any]) -> "Work":
        self._actions.append("not_matched_add")
        self._insert = _assignments(assignments)
        return self

    def not_matched_skip(self) -> "Work":
        self._actions.append("not_matched_skip")
        return self

    def matched_update(self, assignments: dict[str, Any]) -> "Work":
        self._actions.append("matched_update")
        self._update = _assignments(assignments)
        return self

    def matched_delete(self) -> "Work":
        self._actions.append("matched_delete")
        self._delete = True
        return self

    def matched_skip(self) -> "Work":
        self._actions.append("matched_skip")
        return self

    # --- checks ----------------------------------------------------------

    def validate(self, source_columns: list[str] | None = None) -> None:
        """Raise on descriptions that cannot run; starts no Spark job."""
        where = f"work [{self.name}]"
        if self._source is None:
            raise ConfigError(f"{where} has no source")
        if self.target is None:
            raise ConfigError(f"{where} has no target")
        if not self._order:
            raise ConfigError(f"{where} needs order_by: first and last rows depend on it")
        if self._insert is not None and not self._insert:
            raise ConfigError(f"{where}: ADD sets no column, it needs at least one")
        if self._update is not None and not self._update:
            raise ConfigError(f"{where}: UPDATE sets no column, it needs at least one")
        merging = [a for a in self._actions if a != "add"]
        if merging and not self._on:
            raise ConfigError(f"{where}: {', '.join(merging)} needs a merge key")
        if self._on and "add" in self._actions:
            raise ConfigError(f"{where}: with a merge key say not_matched_add instead of add")
        if sum(a.startswith("matched") for a in self._actions) > 1:
            raise ConfigError(f"{where}: one action for matched rows, not several")
        if sum(a.startswith("not_matched") for a in self._actions) > 1:
            raise ConfigError(f"{where}: one action for unmatched rows, not several")
        seen = {self.alias.lower()}
        for lk in self._lookups:
            if not lk.order_by:
                raise ConfigError(f"lookup [{lk.alias}] needs order_by to tell the last duplicate")
            if lk.how not in ("inner", "left"):
                raise ConfigError(f"lookup [{lk.alias}]: how must be inner or left")
            for e, _ in lk.on:
                for r in e.refs():
                    if (r.alias or self.alias).lower() not in seen:
                        raise ConfigError(
                            f"lookup [{lk.alias}]: [{r.alias}] is not known at this point"
                        )
            seen.add(lk.alias.lower())
        for r in self._refs():
            if (r.alias or self.alias).lower() not in seen:
                raise ConfigError(f"{where}: alias [{r.alias}] is no source and no lookup")
            if source_columns is not None and (r.alias or self.alias).lower() == self.alias.lower():
                resolve_name(source_columns, r.column, f"{where}: source")

    def _exprs(self) -> list[Expr]:
        return [
            *[e for e, _ in self._on],
            *(self._insert or {}).values(),
            *(self._update or {}).values(),
        ]

    def _refs(self) -> list[Col]:
        refs = [r for lk in self._lookups for e, _ in lk.on for r in e.refs()]
        refs += self._where.refs() if self._where is not None else []
        return refs + [r for e in self._exprs() for r in e.refs()]

    # --- planning --------------------------------------------------------

    def plan(self, tables: Tables | None = None, clock: JobClock | None = None) -> "WorkPlan":
        tables = {k.lower(): v for k, v in (tables or {}).items()}
        source = normalize_types(_table(self._source, tables, "source"))
        self.validate(source.columns)
        target = _table(self.target, tables, "target")
        ordering = [resolve_name(source.columns, o, "source") for o in self._order]
        if self._row is None:
            # Rows carry their place in the order; only rejects are ever numbered.
            df = source.withColumn(ROW, order_key([F.col(quoted(o)) for o in ordering]))
        else:
            number = F.col(quoted(resolve_name(source.columns, self._row, "source")))
            df = source.withColumn(ROW, number.cast("bigint"))
        names = source.columns
        own = values_of(source)
        scope = Scope(
            self.alias.lower(),
            {self.alias.lower(): {n.lower(): own[n] for n in names}},
            [own[n] for n in names],
            clock or JobClock(),
        )
        order = [F.col(quoted(o)) for o in ordering]
        keys = source.select(*order) if self._row is None else None
        salt = F.xxhash64(*order)
        hits, misses, lookups = [], [], []
        for lk in self._lookups:
            side = _table(lk.table, tables, f"lookup [{lk.alias}]")
            lookups.append((lk.alias, side, [c for _, c in lk.on]))
            spec = Lookup(
                lk.alias,
                side,
                [(e, Col(lk.alias, c)) for e, c in lk.on],
                lk.order_by,
                lk.how,
                sorted({
                    r.column.lower() for r in self._refs()
                    if r.alias and r.alias.lower() == lk.alias.lower()
                }),
            )
            df, scope, hit, miss = attach_lookup(df, scope, spec, salt)
            if lk.how == "inner":
                hits.append(hit)
                misses.append((lk.alias, miss))
        return WorkPlan(self, df, scope, target, order, salt, hits, misses, lookups, keys)


@dataclass
class WorkPlan:
    """Lazy frames of a work over concrete tables."""

    work: Work
    joined: DataFrame
    scope: Scope
    target: DataFrame
    order: list[Column]
    salt: Column
    hits: list[Column]
    misses: list[tuple[str, Column]]
    #: Alias, table and key columns of every lookup.
    lookups: list[tuple[str, DataFrame, list[str]]] = field(default_factory=list)
    #: Order columns of the source, where its rows have no number yet.
    keys: DataFrame | None = None
    # Set by ``stage``: rows by action, already joined and filtered.
    staged: DataFrame | None = None
    written: DataFrame | None = None
    changed: DataFrame | None = None
    _target_values: dict[str, Value] = field(default_factory=dict)

    def __post_init__(self):
        self._target_values = values_of(self.target)

    # --- rows by action ------------------------------------------------------

    @property
    def passing(self) -> DataFrame:
        """Rows with all inner lookups hit that meet the condition."""
        df = self.joined
        for hit in self.hits:
            df = df.where(hit)
        if self.work._where is not None:
            df = df.where(self.work._where.bind(self.scope))
        return df

    @property
    def missed(self) -> DataFrame:
        """Rejects of inner lookups: the first miss names the reason, WHERE plays no part."""
        if not self.misses:
            return self.joined.where(F.lit(False)).select(
                F.col(ROW).alias("row"),
                F.lit("").alias("column"),
                F.lit("").alias("reason"),
            )
        no_hit = reduce(lambda a, b: a | b, [~h for h in self.hits])
        return reject_rows(
            self.joined.where(no_hit).select(ROW, first_failure(self.misses).alias(FAIL))
        )

    @property
    def by_action(self) -> DataFrame:
        """Passing rows with the action they lead to."""
        if self.staged is not None:
            return self.staged.where(F.col(ACTION) != "reject")
        work = self.work
        if not work._on:
            return self.passing.withColumn(ACTION, F.lit("insert"))
        source_keys, target_keys = self._key_sides()
        marked = mark_matches(self.passing, source_keys, self.target, target_keys, self.salt, MATCH)
        on_match = "update" if work._update else "delete" if work._delete else "skip"
        on_new = "insert" if work._insert else "skip"
        return marked.withColumn(
            ACTION, F.when(F.col(MATCH), F.lit(on_match)).otherwise(F.lit(on_new))
        ).drop(MATCH)

    def _key_sides(self) -> tuple[list[Column], list[Column]]:
        pairs = [
            comparable(e.bind(self.scope), self._target_value(c)) for e, c in self.work._on
        ]
        return [p[0] for p in pairs], [p[1] for p in pairs]

    def _target_value(self, column: str) -> Value:
        name = resolve_name(self.target.columns, column, f"target [{self.work.target}]")
        return self._target_values[name]

    def _needed(self) -> list[str]:
        """Columns that assignments, keys and order still use."""
        exprs = self.work._exprs()
        if any(e.whole_row() for e in exprs):
            return self.joined.columns
        refs = [r for e in exprs for r in e.refs()]
        tags = [c for c in self.joined.columns if c.startswith("__k")]
        own = {r.column.lower() for r in refs if (r.alias or self.work.alias).lower()
               == self.work.alias.lower()}
        own |= {o.lower() for o in self.work._order}
        return [c for c in self.joined.columns if c == ROW or c in tags or c.lower() in own]

    def _rows(self, action: str) -> DataFrame:
        needed = [F.col(quoted(c)) for c in self._needed()]
        return self.by_action.where(F.col(ACTION) == action).select(*needed)

    # --- inserts -----------------------------------------------------------

    def tagged_inserts(self) -> DataFrame:
        """Rows to add with ``__row`` and ``__fail``; the key is claimed before conversion."""
        if self.written is not None:
            return self.written
        if not self.work._insert:
            raise ConfigError(f"work [{self.work.name}] adds no rows")
        rows = self._rows("insert")
        if self.work._on:
            source_keys, _ = self._key_sides()
            rows = first_wins(rows, source_keys, self.order)
        return convert_columns(rows, self._assign(self.work._insert), [F.col(ROW)], self._stored())

    def inserts(self) -> DataFrame:
        return good_rows(self.tagged_inserts(), self._set_names(self.work._insert))

    # --- updates and deletes ----------------------------------------------

    def tagged_changes(self) -> DataFrame:
        """Matched rows: new values, match keys and stored-form keys, named ``__ferry_…``."""
        if self.changed is not None:
            return self.changed
        source_keys, _ = self._key_sides()
        action = "update" if self.work._update else "delete"
        sets = self._assign(self.work._update or {})
        keys = []
        for i, (e, c) in enumerate(self.work._on):
            v = e.bind(self.scope)
            keys.append((f"__e{i}", c, v, self._target_value(c).kind, True))
        carried = [
            *[k.alias(f"__ferry_k{i}") for i, k in enumerate(source_keys)],
            *[o.alias(f"__o{i}") for i, o in enumerate(self.order)],
            F.col(ROW),
        ]
        rows = convert_columns(self._rows(action), sets + keys, carried, self._stored())
        values = [F.col(quoted(name)) for name, *_ in sets] or [F.lit(True).alias("x")]
        return rows.select(
            *[f"__ferry_k{i}" for i in range(len(keys))],
            *[F.col(f"__e{i}").alias(f"__ferry_e{i}") for i in range(len(keys))],
            F.struct(*values).alias("__ferry_v"),
            *[f"__o{i}" for i in range(len(self.order))],
            ROW,
            FAIL,
        )

    def changes(self) -> DataFrame:
        """One change per key: the last source row wins. Columns ``__ferry_k*``, ``__ferry_v`` and, of updates, their number ``__ferry_n``."""
        good = self.tagged_changes().where(F.col(FAIL).isNull())
        prefix = "e" if self.work._match == "exact" else "k"
        keys = {f"__ferry_k{i}": F.col(f"__ferry_{prefix}{i}") for i in range(len(self.work._on))}
        if self.work._delete:
            return distinct_keys(good, list(keys.values()), list(keys))
        order = [F.col(f"__o{i}") for i in range(len(self.order))]
        columns = [F.col("__ferry_v")[c].alias(c) for c in self._set_names(self.work._update)]
        return last_per_key(good, keys, columns, order, "__ferry_n")

    # --- results -----------------------------------------------------------

    def rejects(self) -> DataFrame:
        """``(row, column, reason)`` of every row that is neither written nor skipped.

        Where the source has no row numbers, its order columns, and nothing else,
        are sorted and written once to number them; rejects meet their number by key.
        Rows that tie in an order that is not unique get the number of the first.
        """
        frames = [self._missed_rows()]
        if self.work._insert:
            frames.append(reject_rows(self.tagged_inserts()))
        if self.work._update or self.work._delete:
            frames.append(reject_rows(self.tagged_changes()))
        found = reduce(lambda a, b: a.unionAll(b), frames)
        if self.keys is None:
            return found
        numbered = with_row_no(self.keys, self.keys.columns, self.work._first_row, "__no")
        numbers = numbered.groupBy(order_key([F.col(quoted(c)) for c in self.keys.columns]).alias("__key")).agg(
            F.min("__no").alias("__no")
        )
        joined = found.join(numbers, F.col("row").eqNullSafe(F.col("__key")), "left")
        return joined.select(F.col("__no").alias("row"), "column", "reason")

    def lookup_duplicates(self) -> list[DataFrame]:
        """For each lookup ``(work, lookup, keys, duplicates)``: distinct keys, and rows hidden by a later one."""
        return [
            lookup_duplicates(table, columns).select(
                F.lit(self.work.name).alias("work"), F.lit(alias).alias("lookup"), "keys", "duplicates"
            )
            for alias, table, columns in self.lookups
        ]

    def _missed_rows(self) -> DataFrame:
        if self.staged is None:
            return self.missed
        return reject_rows(self.staged.where(F.col(ACTION) == "reject"))

    def apply(self, hit: str | None = None) -> DataFrame:
        """The target after this work: inserts, then updates, then deletes.

        ``hit`` names a column with the number of updates that hit a row.
        """
        work, out = self.work, self.target
        if work._insert:
            out = apply_inserts(out, self.inserts())
        if not (work._update or work._delete):
            return out
        keys = self._stored_keys()
        names = [f"__ferry_k{i}" for i in range(len(keys))]
        if work._update:
            return apply_updates(out, keys, self.changes(), names, self._set_names(work._update), hit)
        return apply_deletes(out, keys, self.changes(), names)

    def _stored_keys(self) -> list[Column]:
        """Target columns that updates and deletes compare with."""
        if self.work._match == "exact":
            return [self._target_value(c).column for _, c in self.work._on]
        return self._key_sides()[1]

    def _assign(self, assignments: dict[str, Expr]) -> list[tuple[str, str, Value, Kind, bool]]:
        operands = []
        for name, e in assignments.items():
            column = resolve_name(self.target.columns, name, f"target [{self.work.target}]")
            kind = kind_of(self.target.schema[column].dataType)
            kind = Kind.TEXT if kind is Kind.CELL else kind
            operands.append((column, name, e.bind(self.scope), kind, True))
        return operands

    def _stored(self) -> dict[str, StructField]:
        return {f.name: f for f in self.target.schema}

    def _set_names(self, assignments: dict[str, Expr]) -> list[str]:
        what = f"target [{self.work.target}]"
        return [resolve_name(self.target.columns, n, what) for n in assignments]

    # --- staging -----------------------------------------------------------

    def stage(self) -> "WorkPlan":
        """Run joins, filter and conversion once and keep the outcome in scratch tables.

        Good rows, rejects and counts are then reads of one written result, and
        random ids exist exactly once.
        """
        work = self.work
        plan = self
        changing = bool(work._update or work._delete)
        # Joined rows are written only if more than one outcome is read from them.
        if bool(work._insert) + changing + bool(self.misses) > 1:
            needed = [F.col(quoted(c)) for c in self._needed()]
            if self.misses:
                rows = self._classified(needed)
            else:
                rows = self.by_action.where(F.col(ACTION) != "skip").select(
                    *needed, F.lit(None).cast(FAILURE_TYPE).alias(FAIL), ACTION
                )
            plan = replace(plan, staged=materialize(rows, "work", [ACTION]))
        if work._insert:
            plan = replace(plan, written=materialize(plan.tagged_inserts(), "added"))
        if changing:
            plan = replace(plan, changed=materialize(plan.tagged_changes(), "changed"))
        return plan

    def _classified(self, needed: list[Column]) -> DataFrame:
        """Lookup rejects and passing rows from one pass over the lookups."""
        all_hit = reduce(lambda a, b: a & b, self.hits)
        keep = all_hit if self.work._where is None else (
            all_hit & self.work._where.bind(self.scope)
        )
        df = self.joined.withColumn(FAIL, first_failure(self.misses)).where(keep | ~all_hit)
        if not self.work._on:
            action = F.lit("insert" if self.work._insert else "skip")
        else:
            source_keys, target_keys = self._key_sides()
            df = mark_matches(df, source_keys, self.target, target_keys, self.salt, MATCH)
            work = self.work
            action = F.when(
                F.col(MATCH),
                F.lit("update" if work._update else "delete" if work._delete else "skip"),
            ).otherwise(F.lit("insert" if work._insert else "skip"))
        df = df.withColumn(ACTION, F.when(F.col(FAIL).isNotNull(), "reject").otherwise(action))
        return df.where(F.col(ACTION) != "skip").select(*needed, FAIL, ACTION)

    def counts(self) -> WorkCounts:
        """Inserted and rejected rows of a staged plan.

        One aggregate per staged table, which reads the outcome column only. Updated
        and deleted rows are counted in the written snapshot, see ``affected``.
        """
        work = self.work
        counts = WorkCounts(work.name)
        if self.staged is not None and self.misses:
            counts.rejected += self.staged.where(F.col(ACTION) == "reject").count()
        if work._insert:
            counts.inserted, bad = _good_and_bad(self.written)
            counts.rejected += bad
        if work._update or work._delete:
            counts.rejected += self.changed.where(F.col(FAIL).isNotNull()).count()
        return counts

    def affected(self, counts: WorkCounts, snapshot: DataFrame) -> None:
        """Count the rows that updates and deletes hit, in the snapshot that was written with its HIT column.

        A target row counts once for every change to it, as if they ran one by one; a deleted row counts once.
        """
        if self.work._update:
            counts.updated = snapshot.agg(F.coalesce(F.sum(HIT), F.lit(0))).first()[0]
        if self.work._delete:
            counts.deleted = self.target.count() + counts.inserted - snapshot.count()


def _good_and_bad(tagged: DataFrame) -> tuple[int, int]:
    bad = F.count_if(F.col(FAIL).isNotNull())
    return tuple(tagged.agg(F.count(F.lit(1)) - bad, bad).first())


def run_works(
    spark: SparkSession,
    works: list[Work],
    tables: Tables,
    clock: JobClock | None = None,
) -> JobResult:
    """Run works in order; each reads the tables as the works before it left them.

    All works are checked before the first one starts. A work that fails while
    writing ends the job with status ``failed``; what earlier works did stays.

    A target that is a ``VersionedTable`` is written: a work that only adds rows
    appends a version, updates and deletes write a snapshot as the next one. Each
    work commits by itself, and fails if another job wrote the table since it read
    it. Targets that are frames stay as they are: added rows are unioned, updates
    and deletes write a new snapshot to scratch.
    """
    for w in works:
        w.validate()
    clock = clock or JobClock()
    began = time.monotonic()
    stores = {k.lower(): v for k, v in tables.items() if isinstance(v, VersionedTable)}
    bases = {k: v.manifest(spark) for k, v in stores.items()}
    state = {k.lower(): v for k, v in tables.items()}
    state |= {k: v.read(spark, bases[k].version) for k, v in stores.items()}
    result = JobResult(clock=clock)
    total = _table(works[0]._source, state, "source").count() if works else 0
    result.total_rows = total
    rejects = []
    for work in works:
        plan = work.plan(state, clock)
        if not (work._insert or work._update or work._delete):
            result.works.append(WorkCounts(work.name))
            continue
        name = work.target.lower()
        try:
            plan = plan.stage()
            counts = plan.counts()
            if name in stores:
                bases[name] = _write(spark, plan, counts, stores[name], bases[name])
                after = stores[name].read(spark, bases[name].version)
            else:
                after = plan.apply(HIT if work._update else None)
                if work._update or work._delete:
                    after = materialize(after, "snapshot")
                    plan.affected(counts, after)
                    after = after.drop(HIT)
        except ConfigError:
            raise
        except Exception as e:  # noqa: BLE001 - any failed write ends the job with its reason
            result.status, result.failure = "failed", f"{work.name}: {e}"
            break
        state[name] = after
        if work._insert:
            result.inserted.setdefault(work.target, []).append(plan.inserts())
        result.works.append(counts)
        result.success_rows += counts.inserted + counts.updated + counts.deleted
        result.error_rows += counts.rejected
        if counts.rejected:
            rejects.append(plan.rejects().select(F.lit(work.name).alias("work"), "*"))
        result.duplicates += plan.lookup_duplicates()
    result.tables = state
    result.versions = {k: m.version for k, m in bases.items()}
    result.elapsed_seconds = time.monotonic() - began
    none = spark.createDataFrame([], "work string, row bigint, column string, reason string")
    result.rejects = reduce(lambda a, b: a.unionAll(b), rejects) if rejects else none
    return result


def _write(spark: SparkSession, plan: WorkPlan, counts: WorkCounts, table: VersionedTable, base: Manifest) -> Manifest:
    """The version of the target after a staged work."""
    work = plan.work
    if not (work._update or work._delete):
        return table.append(plan.inserts(), base)
    part = table.write_part(plan.apply(HIT if work._update else None), base.schema)
    plan.affected(counts, spark.read.parquet(f"{table.path}/{part}"))
    return table.commit(spark, base, [part], "update" if work._update else "delete")


def _assignments(given: dict[str, Any]) -> dict[str, Expr]:
    lowered = [k.lower() for k in given]
    if len(set(lowered)) != len(lowered):
        raise ConfigError("a target column is assigned twice")
    return {k: as_const(v) for k, v in given.items()}


def _table(table: DataFrame | str | None, tables: Tables, what: str) -> DataFrame:
    if isinstance(table, str):
        if table.lower() not in tables:
            raise ConfigError(f"{what}: table [{table}] is not among {', '.join(tables)}")
        found = tables[table.lower()]
        if isinstance(found, VersionedTable):
            raise ConfigError(f"{what}: read the versioned table [{table}] first, or run the work")
        return found
    if table is None:
        raise ConfigError(f"no {what}")
    return table
