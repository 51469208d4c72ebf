"""Merges into dimension / fact tables and file loads (SCD-1…5, LD-1…7, VER-1, VER-2).

Every operator returns a *new snapshot* of the target as a DataFrame (plus counters);
writing is separate (``sources.sinks.SnapshotTable``), so a job never overwrites the
path it is reading. There is no MERGE INTO on Parquet: a merge is joins + ``when``.

Shape of an SCD-2 merge (one pass over the source, two narrow lookups of the target):

* classify   source ⟕ current target[key, SKEY, RWHKEY]          (AQE may broadcast)
* inserts    NEW (+ CHANGED for type 2), numbered by key order from max(SKEY)+1
* expire     current target ⟕ changed keys  -> CURFLG='N', TODT=ts
* snapshot   history ∪ current (expired or kept) ∪ inserts
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import row_hash
from ..functions.scalars import HIGH_DATE, ts_lit
from .changes import CHANGED, NEW, UNCHANGED, classify, current, first_current
from .keys import assign_skey
from ..session import cut_lineage, local_rows

DIM, FCT, MRT, NRM = "DIM", "FCT", "MRT", "NRM"
# System columns of mapped targets, in table order.
SYSTEM_COLUMNS = ("SKEY", "RWHKEY", "CURFLG", "FROMDT", "TODT", "RECCRDT", "RECUPDT")
VALIDITY = ("CURFLG", "FROMDT", "TODT")
# Audit columns of file-load targets.
CREATED_COLUMNS = ("CRTDBY", "CRTDDT", "CREATED_BY", "CREATED_DATE")
UPDATED_COLUMNS = ("UPDTBY", "UPDTDT", "UPDATED_BY", "UPDATED_DATE")


@dataclass
class MergeResult:
    target: DataFrame          # new snapshot of the target
    summary: DataFrame         # long form: metric string, value long
    errors: DataFrame          # rejected source rows (NULL business key)
    duplicates: DataFrame | None = None   # in-batch duplicates that lost to a later row (T1)

    def counters(self) -> dict:
        return {r["metric"]: r["value"] for r in self.summary.collect()}


@dataclass
class LoadResult:
    target: DataFrame          # new snapshot of the target
    rejected: DataFrame        # source rows set aside, with reject_reason
    summary: DataFrame         # metric string, value long: source_rows, accepted_rows, rejected_rows, duplicates
    marked: DataFrame | None = None       # target with _wl_new (row taken from the source) and _wl_dups (rows it stands for, less one)


def _is_dim(kind: str) -> bool:
    return kind.upper() == DIM


def data_columns(df: DataFrame) -> list[str]:
    sysu = set(SYSTEM_COLUMNS)
    return [c for c in df.columns if c.upper() not in sysu]


def target_schema(data_schema: T.StructType, kind: str = DIM) -> T.StructType:
    """Mapped target layout: SKEY, data columns, RWHKEY, validity (DIM only), audit."""
    f = [T.StructField("SKEY", T.LongType())]
    f += [x for x in data_schema.fields if x.name.upper() not in SYSTEM_COLUMNS]
    f += [T.StructField("RWHKEY", T.StringType())]
    if _is_dim(kind):
        f += [T.StructField("CURFLG", T.StringType()), T.StructField("FROMDT", T.TimestampNTZType()),
              T.StructField("TODT", T.TimestampNTZType())]
    f += [T.StructField("RECCRDT", T.TimestampNTZType()), T.StructField("RECUPDT", T.TimestampNTZType())]
    return T.StructType(f)


def empty_target(spark, data_schema: T.StructType, kind: str = DIM) -> DataFrame:
    return local_rows(spark, [], target_schema(data_schema, kind))


def split_null_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """FLT-2 / DQ-1: rows with any NULL key column are set aside."""
    anynull = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.filter(~anynull), df.filter(anynull)


def dropped_duplicates(df: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` that lost the de-duplication (same key, not the winning row); a lazy
    anti join on all columns, evaluated only when asked for (a row identical to the winner is
    not reported: it carries nothing that was lost)."""
    cols = list(df.columns)
    cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols]
    return df.alias("l").join(winners.select(*cols).alias("r"), cond, "left_anti")


def dedup_last(df: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """One row per key: the last by ``order_by`` (ties and no order: the greatest row).

    Written as ``max(struct(order…, rest…))`` per key, an aggregate (sorted by key, as the buffer is a
    struct) with a map-side partial step: a key held by a third of all rows is reduced inside every map task before
    the shuffle instead of being sorted in one task. Adds ``_dups`` (rows dropped per key).
    """
    order_by = list(order_by or [])
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    packed = F.struct(*[F.col(c) for c in order_by + rest]).alias("_w")
    out = df.groupBy(*keys).agg(F.max(packed).alias("_w"), (F.count(F.lit(1)) - 1).alias("_dups"))
    return out.select(*keys, *[F.col("_w." + c).alias(c) for c in df.columns if c not in keys], "_dups") \
              .select(*df.columns, "_dups")


def _metrics(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """One aggregate pass -> long (metric, value) rows."""
    agg = df.agg(*[e.cast("long").alias(k) for k, e in exprs.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in exprs)
    return agg.selectExpr(f"stack({len(exprs)}, {pairs}) as (metric, value)")


def _observed(df: DataFrame, exprs: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` whose next write also counts ``exprs`` (one job writes and counts). To be put right before the write: the tasks of
    the writing stage count once, however often a lost executor makes earlier stages run again."""
    seen = Observation()
    return df.observe(seen, *[F.coalesce(e, F.lit(0)).cast("long").alias(k) for k, e in exprs.items()]), seen


def _summary(spark, counts: dict, bad: DataFrame) -> DataFrame:
    """Counts taken while writing, and the rejected rows (a scan of the key columns), as (metric, value)."""
    known = local_rows(spark, [(k, int(v)) for k, v in counts.items()], "metric string, value long")
    rejected = _metrics(bad, {"error_rows": F.count(F.lit(1)), "source_rows": F.count(F.lit(1))})
    return known.unionByName(rejected).groupBy("metric").agg(F.sum("value").cast("long").alias("value"))


def scd_merge(src: DataFrame, tgt: DataFrame, keys: list[str], ts, scd_type: int = 2, kind: str = DIM,
              order_by: list[str] | None = None, hash_order: list[str] | None = None,
              include_history: bool = True, next_key: int | None = None, unique_target: bool = False) -> MergeResult:
    """SCD-1 / SCD-2 / SCD-3 (run as type 1) / SCD-4 (``kind`` FCT or MRT) merge with SCD-5 counters.

    ``src`` holds the mapped data columns (already named like the target). ``ts`` is the
    run time: inserted rows get FROMDT=RECCRDT=RECUPDT=ts; type-2 expiry sets TODT=ts,
    so validity periods are half-open and meet exactly.

    ``include_history=False`` leaves closed rows of ``tgt`` out of the result (the result is then
    the new current rows plus the rows closed by this run), for stores that keep history
    append-only (``sources.sinks.DimensionTable``); ``next_key`` then gives the first free SKEY. ``unique_target``: the target has one
    current row per key (merges leave it so; ``BucketedTable`` checks it when it is created), so the lookup picks none.
    """
    spark = src.sparkSession
    if scd_type == 3:
        scd_type = 1
    dim = _is_dim(kind)
    t_now = ts_lit(ts)
    data = data_columns(src)
    ok, bad = split_null_keys(src.select(*data), keys)
    dd = dedup_last(ok, keys, order_by)
    losers = dropped_duplicates(ok, dd.drop("_dups"), keys)
    extra = [c for c in (order_by or []) if c not in tgt.columns]   # ordering-only columns
    if extra:
        dd = dd.drop(*extra)
        data = [c for c in data if c not in extra]
    s = dd.withColumn("RWHKEY", row_hash(dd.drop("_dups"), order=hash_order or data))
    # classified source feeds the key numbering and the expiry join: written once to the shared folder so a lost executor
    # re-reads it instead of re-running the lookup join; the counters are taken by the job that writes it
    need_key = (F.col("change") == NEW) if scd_type == 1 or not dim else F.col("change").isin(NEW, CHANGED)
    is_new, is_chg = F.col("change") == NEW, F.col("change") == CHANGED
    overwritten = F.count_if(is_chg) if (scd_type == 1 or not dim) else F.lit(0)
    counted, seen = _observed(classify(s, tgt, keys, unique=unique_target), {
        "source_rows": F.count(F.lit(1)) + F.sum("_dups"),
        "inserted": F.count_if(need_key),
        "updated": overwritten,
        "expired": F.count_if(is_chg) if (scd_type == 2 and dim) else F.lit(0),
        "unchanged": F.count_if(F.col("change") == UNCHANGED),
        "new_keys": F.count_if(is_new),
        "duplicates": F.sum("_dups"),
        "target_rows": F.count_if(need_key) + overwritten,
    })
    cls = cut_lineage(counted, "classified")

    tgt_data = data_columns(tgt)
    types = {f.name: f.dataType for f in tgt.schema.fields}
    start = next_key          # None: continue after max(SKEY) of the target (same job as the counts)
    ins_src = cls.filter(need_key).select(*data, "RWHKEY")
    unmapped = [c for c in tgt_data if c not in data]
    if unmapped and dim and scd_type == 2:
        # a new version keeps the previous version's values in columns this source does not map
        # (the first of several current versions, as in the lookup: one source row makes one new version)
        hold = [c for c in ("SKEY",) if c in tgt.columns]
        now = current(tgt)
        prev = (now if unique_target else first_current(now, keys, [*hold, *unmapped])).select(*keys, *[F.col(c).alias("_p_" + c) for c in unmapped])
        ins_src = ins_src.join(prev, keys, "left")
    ins = assign_skey(ins_src, start, keys, target=tgt)
    ins_cols = [F.col("SKEY")]
    ins_cols += [F.col(c) if c in data else
                 (F.col("_p_" + c).alias(c) if "_p_" + c in ins.columns else F.lit(None).cast(types[c]).alias(c))
                 for c in tgt_data]
    ins_cols += [F.col("RWHKEY")]
    if dim:
        ins_cols += [F.lit("Y").alias("CURFLG"), t_now.alias("FROMDT"),
                     F.lit(HIGH_DATE).cast("timestamp_ntz").alias("TODT")]
    ins_cols += [t_now.alias("RECCRDT"), t_now.alias("RECUPDT")]
    inserts = ins.select(*ins_cols)

    cur = current(tgt) if dim else tgt
    hist = tgt.filter(~(F.col("CURFLG") == F.lit("Y")) | F.col("CURFLG").isNull()) if dim and include_history else None
    if scd_type == 2 and dim:
        chg = cls.filter(F.col("change") == CHANGED).select(*keys, F.lit(True).alias("_hit"))
        j = cur.join(chg, keys, "left")
        hit = F.col("_hit").isNotNull()
        kept = j.select(*[
            F.when(hit, F.lit("N")).otherwise(F.col("CURFLG")).alias("CURFLG") if c == "CURFLG" else
            F.when(hit, t_now).otherwise(F.col("TODT")).alias("TODT") if c == "TODT" else
            F.when(hit, t_now).otherwise(F.col("RECUPDT")).alias("RECUPDT") if c == "RECUPDT" else
            F.col(c) for c in tgt.columns])
    else:
        upd_cols = [c for c in data if c not in keys]
        chg = cls.filter(F.col("change") == CHANGED).select(
            *keys, *[F.col(c).alias("_s_" + c) for c in upd_cols], F.col("RWHKEY").alias("_s_RWHKEY"))
        j = cur.join(chg, keys, "left")
        hit = F.col("_s_RWHKEY").isNotNull()

        def pick(c):
            if c in upd_cols:
                return F.when(hit, F.col("_s_" + c)).otherwise(F.col(c)).alias(c)
            if c == "RWHKEY":
                return F.when(hit, F.col("_s_RWHKEY")).otherwise(F.col(c)).alias(c)
            if c == "RECUPDT":
                return F.when(hit, t_now).otherwise(F.col(c)).alias(c)
            return F.col(c)   # SKEY, RECCRDT and validity columns are never rewritten (T2)
        kept = j.select(*[pick(c) for c in tgt.columns])
    parts = [kept, inserts.select(*tgt.columns)] if hist is None else [hist, kept, inserts.select(*tgt.columns)]
    snapshot = reduce(lambda a, b: a.unionByName(b), parts)

    summary = _summary(spark, seen.get, bad)
    return MergeResult(snapshot, summary, bad, losers)


def scd1_merge(src, tgt, keys, ts, **kw) -> MergeResult:
    """SCD-1"""
    return scd_merge(src, tgt, keys, ts, scd_type=1, **kw)


def scd2_merge(src, tgt, keys, ts, **kw) -> MergeResult:
    """SCD-2"""
    return scd_merge(src, tgt, keys, ts, scd_type=2, **kw)


def fact_merge(src, tgt, keys, ts, **kw) -> MergeResult:
    """SCD-4: insert / overwrite by key, no validity columns."""
    kw.setdefault("kind", FCT)
    return scd_merge(src, tgt, keys, ts, scd_type=1, **kw)


def initial_load(src: DataFrame, keys: list[str], ts, kind: str = DIM, order_by: list[str] | None = None,
                 hash_order: list[str] | None = None) -> MergeResult:
    """First load of a target: the same result as a merge into the empty table, without the
    lookup join (every accepted row is new): de-duplicate, hash, number by key from 1."""
    t_now = ts_lit(ts)
    data = data_columns(src)
    ok, bad = split_null_keys(src.select(*data), keys)
    dd = dedup_last(ok, keys, order_by)
    losers = dropped_duplicates(ok, dd.drop("_dups"), keys)
    extra = [c for c in (order_by or []) if c not in keys]      # ordering-only columns
    if extra:
        dd = dd.drop(*extra)
        data = [c for c in data if c not in extra]
    s = dd.withColumn("RWHKEY", row_hash(dd.drop("_dups"), order=hash_order or data))
    numbered = assign_skey(s.select(*data, "RWHKEY", "_dups"), 1, keys)
    cols = [F.col("SKEY"), *[F.col(c) for c in data], F.col("RWHKEY")]
    if _is_dim(kind):
        cols += [F.lit("Y").alias("CURFLG"), t_now.alias("FROMDT"), F.lit(HIGH_DATE).cast("timestamp_ntz").alias("TODT")]
    cols += [t_now.alias("RECCRDT"), t_now.alias("RECUPDT")]
    m = {"source_rows": F.count(F.lit(1)) + F.sum("_dups"), "inserted": F.count(F.lit(1)), "updated": F.lit(0),
         "expired": F.lit(0), "unchanged": F.lit(0), "new_keys": F.count(F.lit(1)), "duplicates": F.sum("_dups"),
         "target_rows": F.count(F.lit(1))}
    rejected = {"error_rows": F.count(F.lit(1)), "source_rows": F.count(F.lit(1))}
    summary = (_metrics(numbered, m).unionByName(_metrics(bad, rejected))
               .groupBy("metric").agg(F.sum("value").cast("long").alias("value")))
    return MergeResult(numbered.select(*cols), summary, bad, losers)


# ---------------------------------------------------------------- file loads (LD-*)

def align(df: DataFrame, tgt_schema: T.StructType, strict: bool = True) -> DataFrame:
    """LD-6: target column order and names (case repaired), missing columns NULL, cast to the target type
    (``strict=False``: a value that cannot be cast is NULL)."""
    lower = {c.lower(): c for c in df.columns}
    cols = []
    for f in tgt_schema.fields:
        src = lower.get(f.name.lower())
        c = F.col(src) if src is not None else F.lit(None)
        cols.append((c.cast(f.dataType) if strict or src is None else c.try_cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def stamp_load(df: DataFrame, user: str, ts) -> DataFrame:
    """At load time the audit columns present are always overwritten (PRJ-6)."""
    t_now = ts_lit(ts)
    out = df
    for c in df.columns:
        u = c.upper()
        if u in ("CRTDBY", "CREATED_BY", "UPDTBY", "UPDATED_BY"):
            out = out.withColumn(c, F.lit(user))
        elif u in ("CRTDDT", "CREATED_DATE", "UPDTDT", "UPDATED_DATE"):
            out = out.withColumn(c, t_now)
    return out


def split_castable(df: DataFrame, tgt_schema: T.StructType, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that fit the target (``align``ed) and the others with ``reject_reason``: a value that cannot be
    cast to its column's type, or a NULL in a key column. One bad value costs its row, not the load."""
    lower = {c.lower(): c for c in df.columns}
    reasons = []
    for f in tgt_schema.fields:
        src = lower.get(f.name.lower())
        if src is not None and df.schema[src].dataType != f.dataType:
            reasons.append(F.when(F.col(f"`{src}`").isNotNull() & F.col(f"`{src}`").try_cast(f.dataType).isNull(),
                                  F.lit(f"{f.name}: not {f.dataType.simpleString()}")))
    for k in keys or []:
        src = lower.get(k.lower())
        if src is not None:
            reasons.append(F.when(F.col(f"`{src}`").isNull(), F.lit(f"{k}: NULL key")))
    why = F.array_join(F.filter(F.array(*reasons), lambda x: x.isNotNull()), "; ") if reasons else F.lit("")
    marked = df.withColumn("reject_reason", why)
    good = align(marked.where("reject_reason = ''").drop("reject_reason"), tgt_schema, strict=False)
    return good, marked.where("reject_reason <> ''")


def load_checked(df: DataFrame, tgt: DataFrame, mode: str, keys: list[str] | None = None, user: str = "SYSTEM",
                 ts=None, order_by: list[str] | None = None) -> LoadResult:
    """LD-1 INSERT, LD-2 TRUNCATE_LOAD, LD-3 UPSERT (LD-4: no key -> INSERT), LD-7 IF_ABSENT, with the rows
    that could not be loaded and the counts. An upsert is one full outer join on the key (JN-12); it updates the columns that
    ``df`` has (and the audit columns), a target column the file does not map keeps its value."""
    mode = mode.upper()
    if mode not in ("INSERT", "TRUNCATE_LOAD", "UPSERT", "IF_ABSENT"):
        raise ValueError(f"unknown load mode {mode}")
    keyed = mode == "IF_ABSENT" or (mode == "UPSERT" and bool(keys))
    src, rejected = split_castable(df, tgt.schema, keys if keyed else None)
    mapped = {c.upper() for c in df.columns}
    if ts is not None:
        src = stamp_load(src, user, ts)
        mapped |= {*CREATED_COLUMNS, *UPDATED_COLUMNS}
    dups = F.lit(0)
    new, none = F.lit(True).alias("_wl_new"), F.lit(0).cast("long").alias("_wl_dups")
    old = tgt.select("*", F.lit(False).alias("_wl_new"), none)
    if mode == "TRUNCATE_LOAD":
        marked = src.select("*", new, none)
    elif not keyed:
        marked = old.unionByName(src.select("*", new, none))
    else:
        src = dedup_last(src, keys, order_by)          # a key twice in one batch is one row
        dups = F.sum("_dups")
        one = src.withColumnRenamed("_dups", "_wl_dups").withColumn("_wl_new", F.lit(True))
        if mode == "IF_ABSENT":
            marked = old.unionByName(one.join(tgt.select(*keys), keys, "left_anti"))
        else:
            marked = _upsert(one, tgt, keys, mapped)
    counts = _metrics(src, {"accepted_rows": F.count(F.lit(1)), "duplicates": F.coalesce(dups, F.lit(0))}).unionByName(
        _metrics(rejected, {"rejected_rows": F.count(F.lit(1))})).unionByName(_metrics(df, {"source_rows": F.count(F.lit(1))}))
    return LoadResult(marked.select(*tgt.columns), rejected, counts, marked)


def load_into(table, df: DataFrame, version: int, mode: str, keys: list[str] | None = None, user: str = "SYSTEM", ts=None,
              order_by: list[str] | None = None) -> DataFrame:
    """LD-* into a ``SnapshotTable`` with its counts (DQ-8): the job that writes the new version also counts what it takes in, the job
    that writes the rejected rows (``<root>/rejected/v=<version>``) counts them. Returns (metric, value): loaded_rows, duplicates,
    rejected_rows. A version that is committed is not loaded again and returns the counts of its one load."""
    where, spark = f"{table.root}/counts/v={version}", df.sparkSession
    if not table.has_version(version):
        res = load_checked(df, table.read(), mode, keys, user, ts, order_by)
        rejected, bad = _observed(res.rejected, {"rejected_rows": F.count(F.lit(1))})
        rejected.write.mode("overwrite").parquet(f"{table.root}/rejected/v={version}")
        out, seen = _observed(res.marked, {"loaded_rows": F.count_if("_wl_new"), "duplicates": F.sum("_wl_dups"), "table_rows": F.count(F.lit(1))})
        table.write(out.drop("_wl_new", "_wl_dups"), version)
        counts = {**seen.get, **bad.get}
        local_rows(spark, [(k, int(v)) for k, v in counts.items()], "metric string, value long").coalesce(1).write.mode("overwrite").json(where)
        table.record(version)
    return spark.read.schema("metric string, value long").json(where)


def load(df: DataFrame, tgt: DataFrame, mode: str, keys: list[str] | None = None, user: str = "SYSTEM",
         ts=None, order_by: list[str] | None = None) -> DataFrame:
    """The new snapshot of ``load_checked`` (rejected rows are left out)."""
    return load_checked(df, tgt, mode, keys, user, ts, order_by).target


def _upsert(src: DataFrame, tgt: DataFrame, keys: list[str], mapped: set[str]) -> DataFrame:
    """Full outer join on the key; ``src`` has _wl_new and _wl_dups, which the result keeps (of rows the source touched)."""
    s = src.select(*keys, *[F.col(c).alias("_s_" + c) for c in src.columns if c not in keys])
    j = tgt.withColumn("_t_hit", F.lit(True)).join(s, keys, "full_outer")
    created = {c.upper() for c in CREATED_COLUMNS}
    hit, out = F.col("_s__wl_new").isNotNull(), []
    for c in tgt.columns:
        if c in keys:
            out.append(F.col(c))
        elif c.upper() in created or c.upper() not in mapped:     # set by the insert only
            out.append(F.when(F.col("_t_hit").isNotNull(), F.col(c)).otherwise(F.col("_s_" + c)).alias(c))
        else:
            out.append(F.when(hit, F.col("_s_" + c)).otherwise(F.col(c)).alias(c))
    return j.select(*out, hit.alias("_wl_new"), F.coalesce("_s__wl_dups", F.lit(0)).cast("long").alias("_wl_dups"))


def load_counts(df: DataFrame, tgt: DataFrame, keys: list[str]) -> DataFrame:
    """LD-7 counters per distinct key of the batch: created (absent from target) and skipped (present)."""
    t = tgt.select(*keys).distinct().withColumn("_hit", F.lit(True))
    j = df.select(*keys).distinct().join(t, keys, "left")
    return _metrics(j, {"created": F.count_if(F.col("_hit").isNull()),
                        "skipped": F.count_if(F.col("_hit").isNotNull())})


# ---------------------------------------------------------------- versioned rows (VER-*)

def versioned_upsert(src: DataFrame, tgt: DataFrame, key: str, compare_cols: list[str], ts,
                     id_col: str = "id", flag: str = "curflg", created: str = "reccrdt",
                     updated: str = "recupdt") -> DataFrame:
    """VER-1: per code, equal compared columns -> nothing; otherwise the current version is
    closed (flag 'N', updated = ts) and a new version inserted with the next id. Source rows without a code are left out
    (``split_null_keys`` returns them)."""
    t_now = ts_lit(ts)
    src, _ = split_null_keys(src, [key])
    cur = tgt.filter(F.col(flag) == "Y")
    old = tgt.filter(~(F.col(flag) == "Y") | F.col(flag).isNull())
    s = dedup_last(src, [key]).drop("_dups")
    probe = cur.select(key, *[F.col(c).alias("_t_" + c) for c in compare_cols], F.lit(True).alias("_t_hit"))
    js = s.join(probe, key, "left")
    diff = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col("_t_" + c)) for c in compare_cols])
    news = js.filter(F.col("_t_hit").isNull() | diff)
    changed_keys = news.filter(F.col("_t_hit").isNotNull()).select(key, F.lit(True).alias("_close"))
    closed = cur.join(changed_keys, key, "left").select(*[
        F.when(F.col("_close").isNotNull(), F.lit("N")).otherwise(F.col(c)).alias(c) if c == flag else
        F.when(F.col("_close").isNotNull(), t_now).otherwise(F.col(c)).alias(c) if c == updated else
        F.col(c) for c in tgt.columns])
    numbered = assign_skey(news.select(*s.columns), None, [key], col=id_col, target=tgt)
    types = {f.name: f.dataType for f in tgt.schema.fields}
    ins = numbered.select(*[
        F.col(id_col).cast(types[id_col]).alias(id_col) if c == id_col else
        F.lit("Y").alias(c) if c == flag else
        t_now.alias(c) if c in (created, updated) else
        (F.col(c).cast(types[c]).alias(c) if c in s.columns else F.lit(None).cast(types[c]).alias(c))
        for c in tgt.columns])
    return old.unionByName(closed).unionByName(ins)


def version_history(df: DataFrame, key: str, value, flag: str = "curflg", order: str = "recupdt") -> DataFrame:
    """VER-2: closed versions of one code (``value``) or of every code (``value=None``), newest first."""
    out = df.filter(F.col(flag) == "N")
    if value is not None:
        out = out.filter(F.col(key) == F.lit(value))
    return out.orderBy(F.col(key), F.col(order).desc())
