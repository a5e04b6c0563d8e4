"""The registered queries of the engine: each operator on the driver's tables, beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codec, hashing
from ..operators import admit, broker, contract, envelope, erasure, groups, landing, log, offsets, proof, routing, stats, txn
from ..operators.ranking import newest, positions
from . import faults
from .tables import ARRIVALS, LOG, RECORDS, REDELIVERED, arrivals, logged, records, redelivered, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CONTRACT = contract.Contract(24, b"evt:p")


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Contracts and quarantine

VALID = "octet_length(value::blob) between 1 and 24 and starts_with(value, 'evt:p')"


@query(f"select topic as event_type, count(*) as offered, count(*) filter (where {VALID}) as accepted, count(*) filter (where not ({VALID})) as quarantined from {RECORDS} group by topic")
def contract_tally(s, d):
    return contract.tally(records(s, d).withColumnRenamed("topic", "event_type"), CONTRACT, ["event_type"])


@query(f"select arrival // 20 as batch_id, count(*) as records, count(*) filter (where not ({VALID})) as bad, bool_and({VALID}) as accepted from {RECORDS} group by 1")
def batch_atomic_accept(s, d):
    return contract.batches(records(s, d).withColumn("batch_id", F.expr("arrival div 20")), CONTRACT)


@query(f"select arrival, value from {RECORDS} where arrival // 5 in (select arrival // 5 from {RECORDS} group by 1 having bool_and(octet_length(value::blob) between 1 and 17 and starts_with(value, 'evt:')))")
def batch_accepted_records(s, d):
    wide = contract.Contract(17, b"evt:")
    return contract.accepted_records(records(s, d).withColumn("batch_id", F.expr("arrival div 5")), wide).select("arrival", "value")


def rejected(s, d):
    ok = {"bad_seal": F.col("arrival") % 11 != 0, "wrong_route": F.col("stream") % 13 != 0, "contract_mismatch": F.col("arrival") % 17 != 0, "bad_framing": F.col("arrival") % 19 != 0, "contract_violation": contract.Contract(24, b"evt:").accepts(F.col("value"))}
    return records(s, d).withColumn("reason", contract.reason(ok))


REJECTED = f"""(select *, case when arrival % 11 = 0 then 'bad_seal' when stream % 13 = 0 then 'wrong_route' when arrival % 17 = 0 then 'contract_mismatch' when arrival % 19 = 0 then 'bad_framing'
  when not (octet_length(value::blob) between 1 and 24 and starts_with(value, 'evt:')) then 'contract_violation' end as reason from {RECORDS})"""


@query(f"select topic, coalesce(reason, 'accepted') as reason, count(*) as n from {REJECTED} group by all")
def quarantine_reasons(s, d):
    return rejected(s, d).groupBy("topic", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"select topic, count(*) as total, least(count(*), 300) as retained, greatest(count(*) - 300, 0) as evicted from {REJECTED} where reason is not null group by topic")
def quarantine_totals(s, d):
    return contract.quarantine_totals(rejected(s, d), ["topic"], 300)


@query(f"select topic, arrival, reason from (select *, row_number() over (partition by topic order by arrival desc) as n from {REJECTED} where reason is not null) where n <= 50")
def quarantine_retained(s, d):
    return contract.quarantine(rejected(s, d), ["topic"], "arrival", 50).select("topic", "arrival", "reason")


@query(f"select partition, count(*) filter (where reason is null and not again) as delivered, count(*) filter (where reason is null and again) as duplicate, count(*) filter (where reason is not null) as dead from (select *, arrival % 7 = 0 as again from {REJECTED}) group by partition")
def disposition_by_partition(s, d):
    done = rejected(s, d).withColumn("disposition", contract.disposition(F.col("reason"), F.col("arrival") % 7 == 0))
    return stats.tally(done, ["partition"])


@query("select code, count(*) as n from (select case event_id % 5 when 0 then 0 when 1 then 87 when 2 then 10 when 3 then 2 else 56 end as code from events) group by code")
def produce_error_codes(s, d):
    kinds = F.array(*map(F.lit, ("none", "contract", "too_large", "corrupt", "io")))
    return table(s, d, "events").select(contract.parse_error_code(F.get(kinds, (F.col("event_id") % 5).cast("int"))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("select doc_id, octet_length(encode(text)) <= 2000 as fits, contains(text, chr(10)) as has_lf from documents")
def size_guards(s, d):
    return table(s, d, "documents").select("doc_id", contract.within(F.col("text"), 2000).alias("fits"), F.contains(F.col("text").cast("binary"), F.lit(b"\n")).alias("has_lf"))


# Logs and offsets


@query(f'select topic, "partition", "offset", arrival from {LOG}')
def offset_assign(s, d):
    return logged(s, d).select("topic", "partition", "offset", "arrival")


@query(f'select topic, "partition", "offset", value from (select *, coalesce(sum(octet_length(value::blob)) over (partition by topic, "partition" order by "offset" rows between unbounded preceding and 1 preceding), 0) as before from {LOG} where "offset" >= 10) where before < 2000')
def fetch_by_bytes(s, d):
    return log.fetch(logged(s, d), 10, 2000).select("topic", "partition", "offset", "value")


@query(f'select topic, "partition", 0::bigint as earliest, count(*) as latest from {LOG} group by all')
def log_bounds(s, d):
    return log.bounds(logged(s, d))


@query(f'select topic, "partition", time, case when time = -2 then 0 else n end as "offset" from (select topic, "partition", count(*) as n from {LOG} group by all), (select unnest([-2, -1, 1700000000]::bigint[]) as time)')
def list_offsets(s, d):
    b = log.bounds(logged(s, d))
    asks = b.select("topic", "partition", F.explode(F.array(*[F.lit(t).cast("long") for t in (-2, -1, 1700000000)])).alias("time"))
    return log.list_offsets(asks, b)


def commits(s, d):
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("group"), (F.col("o_custkey") % 3).alias("partition"), (F.col("o_orderkey") - 500 * (F.col("o_orderkey") % 3)).alias("offset"), F.col("o_orderkey").alias("ord"))


COMMITS = '(select o_orderpriority as "group", o_custkey % 3 as "partition", o_orderkey - 500 * (o_orderkey % 3) as "offset", o_orderkey as ord from orders)'
LATEST = f'(select "group", "partition", arg_max(greatest("offset", 0), ord) as committed from {COMMITS} group by all)'


@query(f"select * from {LATEST}")
def committed_latest(s, d):
    return offsets.latest(commits(s, d), ["group", "partition"])


@query(f'select b.g as "group", b.p as "partition", latest, committed, latest - coalesce(committed, 0) as lag from (select unnest([\'1-URGENT\', \'5-LOW\', \'nobody\']) as g, p, latest from (select event_id % 4 as p, 100000 + count(*) as latest from events group by 1)) b left join {LATEST} c on c."group" = b.g and c."partition" = b.p')
def consumer_lag(s, d):
    ends = table(s, d, "events").groupBy((F.col("event_id") % 4).alias("partition")).agg((F.count("*") + 100000).alias("latest"))
    asked = ends.withColumn("group", F.explode(F.array(*map(F.lit, ("1-URGENT", "5-LOW", "nobody")))))
    return offsets.lag(offsets.latest(commits(s, d), ["group", "partition"]), asked, ["group", "partition"])


@query(f'select b.g as "group", b.p as "partition", coalesce(committed, -1) as committed from (select unnest([\'1-URGENT\', \'nobody\']) as g, unnest(range(0, 5)) as p from (select 1)) b left join {LATEST} c on c."group" = b.g and c."partition" = b.p where b.g is not null')
def offset_fetch(s, d):
    asks = s.range(5).select(F.col("id").alias("partition")).withColumn("group", F.get(F.array(F.lit("1-URGENT"), F.lit("nobody")), F.col("partition").cast("int"))).where("group is not null").select("group", "partition")
    rest = s.range(2, 5).select(F.lit(None).cast("string").alias("group"), F.col("id").alias("partition")).where("group is not null")
    return offsets.fetch_committed(asks.unionByName(rest), offsets.latest(commits(s, d), ["group", "partition"]), ["group", "partition"])


@query(f"select count(*) as records, count(distinct (\"group\", \"partition\")) as live, count(*) >= 1024 and count(*) > 4 * count(distinct (\"group\", \"partition\")) as due from {COMMITS}")
def compaction_due(s, d):
    return offsets.compaction_due(commits(s, d), ["group", "partition"])


@query(f'select c.* from {COMMITS} c join (select o_custkey % 3 as "partition", count(*) as latest from orders group by 1) b using ("partition") where c."offset" > b.latest')
def commit_beyond_tail(s, d):
    ends = table(s, d, "orders").groupBy((F.col("o_custkey") % 3).alias("partition")).agg(F.count("*").alias("latest"))
    return offsets.beyond_tail(commits(s, d), ends, ["partition"]).select("group", "partition", "offset", "ord")


@query(f'select "group", "partition", committed from {LATEST} where "group" <> \'5-LOW\' union all select \'5-LOW\', unnest([0, 1])::bigint, 7')
def offset_restore(s, d):
    now = offsets.latest(commits(s, d), ["group", "partition"])
    snapshot = s.range(3).select(F.lit("5-LOW").alias("group"), F.col("id").alias("partition"), F.when(F.col("id") < 2, F.lit(7)).cast("long").alias("committed"))
    return offsets.restore(now, snapshot, ["group", "partition"])


@query("select conv_id, turn, role from (select *, row_number() over (order by conv_id, turn) - 1 as pos from conversations) where pos >= 5 and pos < 41")
def replay_range(s, d):
    c = table(s, d, "conversations")
    at = positions(c.withColumn("__at", F.col("conv_id") * 1000 + F.col("turn")).withColumn("__log", F.lit(0)), ["__log"], "__at", "pos")
    return log.replay(at, "5..=40").select("conv_id", "turn", "role")


STARTS = f'(select topic, "partition", "offset" as start from {LOG} where "offset" % 25 = 5)'


@query(f'select e.topic, e."partition", e."offset", s.start as start_of from {LOG} e asof left join {STARTS} s on e.topic = s.topic and e."partition" = s."partition" and e."offset" >= s.start')
def segment_asof(s, d):
    l = logged(s, d).select("topic", "partition", "offset")
    starts = l.where("offset % 25 = 5").withColumnRenamed("offset", "start")
    return log.as_of(l, starts, ["topic", "partition"], "offset", "start")


BAD = '("offset" % 37 = 36)'


@query(f'select topic, "partition", "offset", value from {LOG} l where "offset" < coalesce((select min("offset") from {LOG} b where b.topic = l.topic and b."partition" = l."partition" and b."offset" % 37 = 36), 1000000000)')
def torn_tail_recovery(s, d):
    return log.until_bad(logged(s, d), ["topic", "partition"], "offset", F.expr("offset % 37 = 36")).select("topic", "partition", "offset", "value")


@query(f'select topic, "partition", case when min("offset") filter (where {BAD}) = min("offset") then 2 else 0 end as error, count(*) filter (where "offset" < first_bad or first_bad is null) as records from (select *, min("offset") filter (where {BAD}) over (partition by topic, "partition") as first_bad from {LOG} where "offset" >= 36 or "partition" > 0) group by topic, "partition"')
def corrupt_prefix_fetch(s, d):
    asked = logged(s, d).where("offset >= 36 or partition > 0")
    return log.fetch_status(asked, ["topic", "partition"], "offset", F.expr("offset % 37 = 36"))


@query(f'select topic, "partition", "offset" from (select *, "offset" // 50 as segment from {LOG}) l where not exists (select 1 from {LOG} b where b.topic = l.topic and b."partition" = l."partition" and b."offset" // 50 = l.segment and b."offset" % 37 = 36 and b."offset" <= l."offset")')
def resync_segments(s, d):
    frames = logged(s, d).withColumn("segment", F.expr("offset div 50"))
    return log.until_bad(frames, ["topic", "partition", "segment"], "offset", F.expr("offset % 37 = 36")).select("topic", "partition", "offset")


@query(f'select topic, "partition", "offset", value from {LOG} where "offset" < 17')
def log_truncate(s, d):
    return log.truncate(logged(s, d), 17).select("topic", "partition", "offset", "value")


@query(f"""with recursive l as materialized (select topic, "partition", "offset", octet_length(value::blob) + 8 as size from {LOG}),
f as (select topic, "partition", "offset", 0::bigint as segment, 0::bigint as byte_offset, size from l where "offset" = 0 union all
  select l.topic, l."partition", l."offset", case when f.byte_offset + f.size - f.segment >= 512 then f.byte_offset + f.size else f.segment end, f.byte_offset + f.size, l.size
  from f join l on l.topic = f.topic and l."partition" = f."partition" and l."offset" = f."offset" + 1)
select topic, "partition", "offset", segment, byte_offset from f""")
def segment_rotate(s, d):
    return log.rotate(logged(s, d), 512).select("topic", "partition", "offset", "segment", "byte_offset")


@query(f'select topic, "partition", "offset" from {LOG} where "offset" >= 30')
def tiered_replay(s, d):
    l = logged(s, d).select("topic", "partition", "offset")
    return log.tiered(l.where("offset >= 40"), l.where("offset < 60"), 30)


@query(f'select distinct topic, "partition", "offset" // 16 as segment from {LOG}')
def segment_starts(s, d):
    l = logged(s, d).withColumn("segment", F.expr("offset div 16"))
    return log.segment_starts(l.where("offset >= 48"), l.where("offset < 64"))


@query(f'select topic, "partition", "offset" as at from {LOG} where "offset" % 6 = 0 and "offset" % 4 = 0')
def frame_boundaries(s, d):
    l = logged(s, d).select("topic", "partition", F.col("offset").alias("at"))
    return log.frame_boundary(l.where("at % 6 = 0"), l.where("at % 4 = 0").withColumnRenamed("at", "start"), ["topic", "partition"], "at", "start")


@query("select distinct event_type as topic, unnest(range(0, 4))::int as partition, 0 as leader from events")
def broker_metadata(s, d):
    return log.metadata(table(s, d, "events").select(F.col("event_type").alias("topic")).distinct(), 4)


@query("select distinct lower(hex(event_type)) || '-' || (user_id % 3) as dir from events")
def partition_dirs(s, d):
    return records(s, d).select(log.partition_dir(F.col("topic"), F.col("partition")).alias("dir")).distinct()


@query(f"select partition, arrival, value, sum(octet_length(value::blob)) over (partition by partition order by arrival)::bigint as landed_bytes from {RECORDS}")
def landed_running_total(s, d):
    from ..operators.ranking import running_total

    size = F.octet_length(F.col("value").cast("binary")).cast("long")
    return running_total(records(s, d), ["partition"], "arrival", size, "before").select("partition", "arrival", "value", (F.col("before") + size).cast("long").alias("landed_bytes"))


@query("select o_custkey % 3 as partition, o_orderkey as request, coalesce(sum(1 + o_orderkey % 5) over (partition by o_custkey % 3 order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as base from orders")
def sequence_reservation(s, d):
    asks = table(s, d, "orders").select((F.col("o_custkey") % 3).alias("partition"), F.col("o_orderkey").alias("request"))
    return landing.reserve(asks, ["partition"], "request", 1 + F.col("request") % 5).select("partition", "request", "base")


# Admission and landing


@query(f"select stream, coalesce(min(case when seq <> n then n end), count(*)) as low_watermark, count(*) as present from (select stream, seq, row_number() over (partition by stream order by seq) - 1 as n from {ARRIVALS} where arrival % 17 <> 3) group by stream")
def contiguous_watermark(s, d):
    return admit.contiguous_watermark(arrivals(s, d).where("arrival % 17 <> 3"))


@query(f"select stream, min(seq) as first, max(seq) as last from (select stream, seq, seq - row_number() over (partition by stream order by seq) as run from {ARRIVALS} where arrival % 17 <> 3) group by stream, run")
def sequence_islands(s, d):
    return admit.islands(arrivals(s, d).where("arrival % 17 <> 3"))


FIRST = f"(select *, case when row_number() over (partition by stream, seq order by arrival) = 1 then 'Delivered' else 'Duplicate' end as disposition from {REDELIVERED})"


@query(f"select stream, arrival, seq, disposition from {FIRST}")
def admit_first(s, d):
    return admit.admit_bound(redelivered(s, d)).select("stream", "arrival", "seq", "disposition")


@query(f"select stream, arrival, seq, key, disposition from {FIRST}")
def admit_exact(s, d):
    return admit.admit(redelivered(s, d).select("stream", "arrival", "seq", "key")).select("stream", "arrival", "seq", "key", "disposition")


@query()
def admit_conflicting_keys(s, d):
    """Keys that come under other sequence numbers, in shuffled order: only the fold gets these right."""
    a = redelivered(s, d).withColumn("key", F.concat(F.col("stream").cast("string"), F.lit("/"), F.expr("seq div 2").cast("string"))).withColumn("arrival", F.col("arrival") * 7 % 1000003)
    return admit.admit(a.select("stream", "arrival", "seq", "key"), horizon=8, gc_lag=4)


@query(f"select stream, count(*) filter (where disposition = 'Delivered') as delivered, count(*) filter (where disposition = 'Duplicate') as duplicate, 0::bigint as dead from (select stream, case when row_number() over (partition by stream, seq order by k, arrival) = 1 then 'Delivered' else 'Duplicate' end as disposition from {ARRIVALS}, range(0, 4) r(k)) group by stream")
def duplicate_flood(s, d):
    flood = arrivals(s, d).crossJoin(F.broadcast(s.range(4).withColumnRenamed("id", "k"))).withColumn("arrival", F.col("arrival") + F.col("k") * 1_000_000_000)
    return stats.tally(admit.admit_bound(flood), ["stream"])


def stored(s, d):
    return arrivals(s, d).where("stream % 4 <> 0").groupBy("stream").agg(F.expr("count(*) div 2").alias("watermark"))


STORED = f"(select stream, count(*) // 2 as watermark from {ARRIVALS} where stream % 4 <> 0 group by stream)"


@query(f"select a.stream, a.seq as pos, a.value from {ARRIVALS} a left join {STORED} w using (stream) where a.seq >= coalesce(w.watermark, 0)")
def landed_suffix(s, d):
    return landing.suffix(arrivals(s, d).withColumnRenamed("seq", "pos"), stored(s, d)).select("stream", "pos", "value")


BATCHED = f"(select *, (seq // 10 + 1) * 10 as mark from {ARRIVALS})"


@query(f"select b.stream, b.seq, b.value from {BATCHED} b left join {STORED} w using (stream) where w.watermark is null or b.mark > w.watermark")
def landed_sequence(s, d):
    b = arrivals(s, d).withColumn("mark", F.expr("(seq div 10 + 1) * 10"))
    return landing.whole(b, stored(s, d), mark="mark").select("stream", "seq", "value")


@query(f"select stream, max(watermark) as watermark from (select * from {STORED} union all select stream, max(seq) + 1 from {ARRIVALS} where stream % 3 = 0 group by stream) group by stream")
def watermark_upsert(s, d):
    new = arrivals(s, d).where("stream % 3 = 0").groupBy("stream").agg((F.max("seq") + 1).alias("watermark"))
    return landing.upsert(stored(s, d), new)


@query(f"select stream, coalesce(watermark, 0) as resume_at from (select distinct stream from {ARRIVALS}) left join {STORED} using (stream)")
def resume_points(s, d):
    return landing.resume(arrivals(s, d).select("stream").distinct(), stored(s, d))


@query(f"select a.stream, a.seq as pos, a.value from {ARRIVALS} a join (select stream, min(seq) as f from {ARRIVALS} where arrival % 5 <> 0 and seq >= 3 or seq = 5 group by stream) m on a.stream = m.stream and a.seq >= m.f")
def resend_set(s, d):
    out = arrivals(s, d).withColumnRenamed("seq", "pos")
    unacked = F.expr("(arrival % 5 <> 0 and pos >= 3) or pos = 5")
    return admit.resend(out, out.where(~unacked)).select("stream", "pos", "value")


@query(f'select "partition", min(segment) filter (where not acked) as floor, count(*) filter (where not acked) as in_flight from (select "partition", arrival // 100 as segment, arrival % 3 <> 1 or arrival < 700 as acked from {RECORDS}) group by 1')
def ack_floor(s, d):
    r = records(s, d).withColumn("segment", F.expr("arrival div 100")).withColumn("acked", F.expr("arrival % 3 <> 1 or arrival < 700"))
    return admit.ack_floor(r, ["partition"])


# Transactions and groups


def transactions(s, d):
    o = table(s, d, "orders")
    marks = o.where("o_orderstatus in ('F', 'O')").select((F.col("o_custkey") % 50).alias("producer_id"), F.col("o_orderkey").alias("epoch"), (F.col("o_orderkey") * 10 + 9).alias("ord"), (F.col("o_orderstatus") == "F").alias("commit"))
    l = table(s, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).alias("producer_id")), "l_orderkey")
    buffered = l.select("producer_id", F.col("l_orderkey").alias("epoch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_partkey").alias("value"))
    return buffered, marks


BUFFERED = "(select o_custkey % 50 as producer_id, l_orderkey as epoch, l_orderkey * 10 + l_linenumber as ord, l_partkey as value from lineitem join orders on l_orderkey = o_orderkey)"


@query(f"select b.* from {BUFFERED} b join orders o on b.epoch = o.o_orderkey where o.o_orderstatus = 'F' and b.ord < o.o_orderkey * 10 + 9")
def txn_visible(s, d):
    return txn.visible(*transactions(s, d))


@query(f"select b.* from {BUFFERED} b left join (select o_custkey % 50 as producer_id, max(o_orderkey) as m from orders where o_orderstatus in ('F', 'O') group by 1) e using (producer_id) where e.m is null or b.epoch > e.m")
def txn_pending(s, d):
    return txn.pending(*transactions(s, d))


@query("select o_orderkey as request, o_custkey::varchar as transactional_id, case when exists (select 1 from orders h where h.o_orderstatus = 'P' and h.o_custkey % 40 = o.o_custkey % 40 and h.o_custkey <> o.o_custkey) then 51 else 0 end as code from orders o where o_orderstatus = 'O'")
def txn_claim_conflicts(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("string").alias("transactional_id"), F.lit("t").alias("topic"), (F.col("o_custkey") % 40).alias("partition"))
    return txn.claim_conflicts(o.where("o_orderstatus = 'O'").withColumnRenamed("o_orderkey", "request"), o.where("o_orderstatus = 'P'"))


@query("select o_custkey::varchar as transactional_id, o_orderkey as ord, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as epoch from orders")
def txn_init_epochs(s, d):
    return txn.init_producers(table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("transactional_id"), F.col("o_orderkey").alias("ord"))).select("transactional_id", "ord", "epoch")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_suppkey % 5 <> 0 and (l_partkey % 7 = 0 or l_linenumber = 3) then 47 when l_suppkey % 5 = 0 and l_partkey % 7 = 0 then 47 when l_linenumber = 3 then 47 when l_suppkey % 5 = 0 or l_orderkey % 4 = 0 then 48 else 0 end as code from lineitem")
def txn_fencing(s, d):
    l = table(s, d, "lineitem")
    code = txn.produce_code(F.lit(1), F.when(F.col("l_partkey") % 7 == 0, 2).otherwise(1), F.col("l_suppkey") % 5 != 0, F.col("l_orderkey") % 4 != 0, F.lit(1), F.when(F.col("l_linenumber") == 3, 3).otherwise(1))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code.alias("code"))


@query("select 'g' as \"group\", 't' as topic, o_custkey % 3 as partition, floor(o_totalprice)::bigint as \"offset\", o_orderkey * 10 + 9 as ord from orders where o_orderstatus = 'F'")
def txn_staged_offsets(s, d):
    _, marks = transactions(s, d)
    staged = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("producer_id"), F.col("o_orderkey").alias("epoch"), F.lit("g").alias("group"), F.lit("t").alias("topic"), (F.col("o_custkey") % 3).alias("partition"), F.floor("o_totalprice").alias("offset"))
    return txn.staged_offsets(staged, marks)


def group_members(s, d):
    c = table(s, d, "customer")
    options = F.array(F.lit("range"), F.lit("sticky"), F.lit("uniform"))
    picked = F.filter(options, lambda p, i: (F.col("c_custkey") + i) % (F.col("c_nationkey") % 4 + 2) != 0)
    return c.select(F.col("c_nationkey").alias("group"), F.format_string("m%05d", "c_custkey").alias("member"), F.when(F.size(picked) > 0, picked).otherwise(options).alias("protocols"))


MEMBERS = """(select c_nationkey as "group", printf('m%05d', c_custkey) as member, case when len(p) > 0 then p else ['range', 'sticky', 'uniform'] end as protocols from
  (select *, [x for x, i in ['range', 'sticky', 'uniform'] if (c_custkey + i - 1) % (c_nationkey % 4 + 2) <> 0] as p from customer))"""


@query(f'''with m as {MEMBERS}, n as (select "group", count(*) as size, arg_min(protocols, member) as first from m group by 1), v as (select "group", p, count(*) as votes from (select "group", member, unnest(protocols) as p from m) group by all),
common as (select v."group", list(v.p) as common from v join n on v."group" = n."group" and v.votes = n.size group by 1)
select n."group", coalesce([x for x in first if list_contains(common, x)][1], first[1]) as protocol from n left join common using ("group")''')
def group_protocol(s, d):
    return groups.protocol(group_members(s, d))


@query("select l_suppkey as member, l_partkey % 16 as partition, count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey < 12) group by all")
def assignment_route(s, d):
    asked = table(s, d, "lineitem").select(F.lit("g").alias("group"), F.col("l_suppkey").alias("member"), (F.col("l_partkey") % 16).alias("partition"))
    members = table(s, d, "supplier").where("s_nationkey < 12").select(F.lit("g").alias("group"), F.col("s_suppkey").alias("member"))
    return groups.assigned(asked, members).groupBy("member", "partition").agg(F.count("*").alias("n"))


@query("select event_type as \"group\", user_id as member, max(epoch_us(ts) // 1000) as last from events group by all having (select max(epoch_us(ts) // 1000) from events) - max(epoch_us(ts) // 1000) >= 30000000")
def session_expired(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("group"), F.col("user_id").alias("member"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    now = e.agg(F.max("at")).first()[0]
    return groups.expired(e, F.lit(now), F.lit(30_000_000))


@query("select code, count(*) as n from (select case when user_id % 9 = 0 then 25 when event_id % 5 = 0 then 22 when event_id % 3 = 0 then 27 else 0 end as code from events) group by code")
def heartbeat_codes(s, d):
    state = F.when(F.col("event_id") % 3 == 0, F.lit(groups.PREPARING)).otherwise(F.lit(groups.STABLE))
    code = groups.heartbeat_code(F.col("user_id") % 9 != 0, F.when(F.col("event_id") % 5 == 0, 1).otherwise(2), F.lit(2), state)
    return table(s, d, "events").select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query()
def group_membership(s, d):
    e = table(s, d, "events")
    kinds = F.array(*map(F.lit, ("join", "heartbeat", "sync", "heartbeat", "leave")))
    events = e.select(F.col("event_id").alias("ord"), (F.col("event_id") * 700).alias("now_ms"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"), F.col("event_type").alias("group"), (F.col("user_id") % 6).cast("string").alias("member"), F.expr("cast(event_id div 50 as int)").alias("generation"), F.lit(60_000).alias("session_ms"))
    return groups.membership(events)


# Routing: 64-bit wrapping products as 128-bit numbers modulo 2^64

M64 = "18446744073709551616::uhugeint"


FNV = f"list_reduce(list_prepend(14695981039346656037::uhugeint, [ascii(c)::uhugeint for c in string_split(key, '')]), lambda h, c: (xor(h, c) * 1099511628211::uhugeint) % {M64})"
KEYS = "(select distinct 'key-' || c_custkey as key from customer)"
WEIGHTS = f"""(with k as (select key, ({FNV})::ubigint as h from {KEYS}),
 n0 as (select s_suppkey as node, xor(s_suppkey::ubigint, s_suppkey::ubigint >> 33) as a from supplier), n1 as (select node, (a::uhugeint * 18397679294719823053::uhugeint % {M64})::ubigint as a from n0), n2 as (select node, (xor(a, a >> 33)::uhugeint * 14181476777654086739::uhugeint % {M64})::ubigint as a from n1), n as (select node, xor(a, a >> 33) as m from n2),
 p0 as (select key, node, xor(h, m) as a from k, n), p1 as (select key, node, (xor(a, a >> 33)::uhugeint * 18397679294719823053::uhugeint % {M64})::ubigint as a from p0), p2 as (select key, node, (xor(a, a >> 33)::uhugeint * 14181476777654086739::uhugeint % {M64})::ubigint as a from p1)
 select key, node, xor(a, a >> 33) as w from p2)"""


def route_keys(s, d):
    return table(s, d, "customer").select(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("key")).distinct()


def route_nodes(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("node"))


@query(f"select key, node from (select *, row_number() over (partition by key order by w desc, node) as n from {WEIGHTS}) where n = 1")
def rendezvous_route(s, d):
    return routing.route(route_keys(s, d), route_nodes(s, d))


@query(f"select key, (row_number() over (partition by key order by w desc, node) - 1)::int as rank, node from {WEIGHTS}")
def rendezvous_rank(s, d):
    return routing.preference(route_keys(s, d), route_nodes(s, d))


@query(f"with w as {WEIGHTS}, b as (select key, arg_max(node, w) as old from w group by key), a as (select key, arg_max(node, w) as new from w where node % 10 <> 3 group by key) select * from b join a using (key) where old <> new")
def rendezvous_churn(s, d):
    return routing.moved(routing.route(route_keys(s, d), route_nodes(s, d)), routing.route(route_keys(s, d), route_nodes(s, d).where("node % 10 <> 3")))


# Hashes, codecs, integrity


@query("select doc_id, sha256(text) as address from documents")
def content_address(s, d):
    return table(s, d, "documents").select("doc_id", hashing.sha256_hex(F.col("text")).alias("address"))


IPAD, OPAD = ("".join(f"{b ^ m:02x}" for b in b"tenant-key".ljust(64, b"\0")) for m in (0x36, 0x5C))


@query(f"select event_id, sha256(from_hex('{OPAD}') || from_hex(sha256(from_hex('{IPAD}') || ('rk-' || event_id)::blob))) as key from events")
def idempotency_key(s, d):
    return table(s, d, "events").select("event_id", hashing.hmac_sha256(b"tenant-key", F.concat(F.lit("rk-"), F.col("event_id").cast("string"))).alias("key"))


@query("select doc_id, replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') as escaped from documents")
def copy_escape(s, d):
    return table(s, d, "documents").select("doc_id", hashing.copy_escape(F.col("text")).alias("escaped"))


@query("select page_id, md5(html) as md5, to_base64(encode(html)) as b64 from pages")
def digests(s, d):
    return table(s, d, "pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("md5"), F.regexp_replace(F.base64(F.col("html").cast("binary")), "[\r\n]", "").alias("b64"))


CRC_SQL = """list_reduce(list_prepend(4294967295::bigint, [('0x' || x)::bigint for x in regexp_extract_all(h, '..')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"""


def crc_table(polynomial: int) -> str:
    return f"(select list(list_reduce(list_prepend(n, range(0, 8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, {polynomial}) else c >> 1 end) order by n) from (select unnest(range(0, 256)) as n))"


@query(f"""with d as (select doc_id, hex(encode(text)) as h from documents),
a as (select doc_id, xor({CRC_SQL}, 4294967295) as crc32 from d, {crc_table(0xEDB88320)} q(t)), b as (select doc_id, xor({CRC_SQL}, 4294967295) as crc32c from d, {crc_table(0x82F63B78)} q(t))
select doc_id, crc32, crc32c from a join b using (doc_id)""")
def crc_checks(s, d):
    return table(s, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"), hashing.crc32c("text").alias("crc32c"))


@query(f"select key, ({FNV})::varchar as fnv from {KEYS}")
def fnv_hash(s, d):
    return route_keys(s, d).select("key", hashing.fnv1a_64("key").cast("string").alias("fnv"))


@query("select event_id, case when event_id % 2 = 0 then event_id * 2 else (event_id - 5000) * 2 * (case when event_id < 5000 then -1 else 1 end) - (case when event_id < 5000 then 1 else 0 end) end as z from events")
def zigzag_numbers(s, d):
    n = F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(F.col("event_id") - 5000)
    return table(s, d, "events").select("event_id", hashing.zigzag(n).alias("z"))


@query(f"select batch_id, n as sent, n as received, batch_id as producer_id, (batch_id * 50)::int as base_sequence, 0 as error from (select arrival // 50 as batch_id, count(*)::int as n from {RECORDS} group by 1)")
def record_batch_roundtrip(s, d):
    """Produce batches written and read again: values, sequence range and checksum survive."""
    b = records(s, d).withColumn("batch_id", F.expr("arrival div 50")).groupBy("batch_id").agg(F.array_sort(F.collect_list("value")).alias("values"))
    wire = b.select("batch_id", F.size("values").alias("sent"), codec.encode_batch("values", F.col("batch_id"), F.lit(3), (F.col("batch_id") * 50).cast("int")).alias("wire"))
    return wire.withColumn("got", codec.decode_batch("wire")).select("batch_id", "sent", F.size("got.values").alias("received"), "got.producer_id", "got.base_sequence", "got.error")


@query(f"select batch_id, n as records, case when batch_id % 5 = 0 then 'bad_seal' end as reason, case when batch_id % 5 <> 0 then n end as opened from (select arrival // 20 as batch_id, count(*)::int as n from {RECORDS} group by 1)")
def envelope_roundtrip(s, d):
    """Batches sealed, some then damaged, opened: each failure has its reason."""
    rows = records(s, d).withColumn("batch_id", F.expr("arrival div 20")).withColumnRenamed("arrival", "ord")
    sealed = envelope.seal(envelope.framed(rows), contract.Contract(64, b"evt:"), b"k" * 32, b"s" * 32, b"route-0000000001", F.lit(b"stream-000000001"), F.col("batch_id"), F.col("batch_id").cast("string"), F.col("payload"))
    damaged = sealed.withColumn("payload", F.when(F.col("batch_id") % 5 == 0, F.concat("payload", F.lit(b"x"))).otherwise(F.col("payload")))
    return envelope.opened(damaged, contract.Contract(64, b"evt:"), b"k" * 32, b"s" * 32, b"route-0000000001").select("batch_id", "records", "reason", F.size("values").alias("opened"))


LEAVES = "(select event_type as log_id, row_number() over (partition by event_type order by event_id) - 1 as idx, sha256(event_id::varchar) as hash from events)"


def leaves(s, d):
    e = positions(table(s, d, "events").select(F.col("event_type").alias("log_id"), "event_id"), ["log_id"], "event_id", "idx")
    return e.select("log_id", "idx", F.unhex(F.sha2(F.col("event_id").cast("string"), 256)).alias("hash"))


@query(f"select l.log_id, l.idx // 2 as idx, case when r.hash is null then l.hash else sha256('\\x01'::blob || from_hex(l.hash) || from_hex(r.hash)) end as hash from {LEAVES} l left join {LEAVES} r on l.log_id = r.log_id and r.idx = l.idx + 1 where l.idx % 2 = 0")
def merkle_level(s, d):
    return proof.next_level(leaves(s, d)).select("log_id", "idx", F.lower(F.hex("hash")).alias("hash"))


@query(f"""with recursive t(log_id, idx, hash, most) as (select log_id, idx, hash, max(idx) over (partition by log_id) from {LEAVES} union all
  select log_id, idx // 2, case when r is null then hash else sha256('\\x01'::blob || from_hex(hash) || from_hex(r)) end, most // 2
  from (select log_id, idx, hash, most, lead(hash) over (partition by log_id order by idx) as r from t) where idx % 2 = 0 and most > 0)
select log_id, hash as root from t where most = 0""")
def merkle_roots(s, d):
    return proof.roots(leaves(s, d))


@query(f"select log_id, count(*) as leaves, count(*) as verified from {LEAVES} group by log_id")
def inclusion_verify(s, d):
    l = leaves(s, d)
    heads = proof.heads(l).withColumn("root", F.unhex("root"))
    proofs = proof.with_heads(proof.proved(l), heads)
    ok = proof.included(F.col("hash"), F.col("idx"), F.col("size"), F.col("path"), F.col("root"))
    return proofs.groupBy("log_id").agg(F.count("*").alias("leaves"), F.count_if(ok).alias("verified"))


@query(f"select event_type as log_id, event_id, sha256(from_hex(sha256(event_id::varchar)) || 'r'::blob || event_type::blob || from_hex(rpad(printf('%02x%02x%02x%02x', event_id % 256, event_id // 256 % 256, event_id // 65536 % 256, event_id // 16777216), 16, '0')) || from_hex('0100000000000000')) as leaf from events")
def leaf_hashes(s, d):
    e = table(s, d, "events")
    made = proof.leaf(F.unhex(F.sha2(F.col("event_id").cast("string"), 256)), F.lit(b"r"), F.col("event_type"), F.col("event_id"), F.lit(1))
    return e.select(F.col("event_type").alias("log_id"), "event_id", F.lower(F.hex(made)).alias("leaf"))


@query("select doc_id, i as idx, md5(array_to_string(string_split(hex(encode(text)), '')[i * 2000 + 1 : i * 2000 + 2000], '')) as piece from (select *, unnest(range(0, greatest((octet_length(encode(text)) + 999) // 1000, 1))) as i from documents)")
def chunk_split(s, d):
    return proof.chunks(table(s, d, "documents"), "doc_id", "text", 1000).select("doc_id", "idx", F.md5(F.hex("bytes").cast("binary")).alias("piece"))


@query("select doc_id, i as idx from (select *, unnest(range(0, greatest((octet_length(encode(text)) + 999) // 1000, 1))) as i from documents) where (doc_id + i) % 4 = 0")
def chunk_missing(s, d):
    c = proof.chunks(table(s, d, "documents"), "doc_id", "text", 1000)
    return proof.missing(c.where("(doc_id + idx) % 4 <> 0"), c.select("doc_id", "total").distinct(), "doc_id")


@query("select doc_id, md5(text) as md5 from documents")
def chunk_reassemble(s, d):
    return proof.reassemble(proof.chunks(table(s, d, "documents"), "doc_id", "text", 1000), "doc_id").select("doc_id", F.md5("data").alias("md5"))


@query("select doc_id, md5(text) as md5 from documents")
def erasure_roundtrip(s, d):
    code = erasure.Code(4, 2)
    shards = erasure.encode(table(s, d, "documents"), code, "doc_id", "text")
    left = shards.where((F.col("idx") != F.col("id") % 6) & (F.col("idx") != (F.col("id") + 1 + F.col("id") % 5) % 6))
    return erasure.restore(left, code).select(F.col("id").alias("doc_id"), F.md5("value").alias("md5"))


# Statistics and set operations


@query("""with r as (select l_returnflag as flag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as k, count(*) over (partition by l_returnflag) as n from lineitem)
select flag, min(v) filter (where k = (n - 1) * 500 // 1000) as p50, min(v) filter (where k = (n - 1) * 900 // 1000) as p90, min(v) filter (where k = (n - 1) * 990 // 1000) as p99, min(v) filter (where k = (n - 1) * 999 // 1000) as p999, max(v) as max, count(*) as count from r group by flag""")
def nearest_rank_percentiles(s, d):
    l = table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return stats.nearest_rank(l, ["flag"], "l_extendedprice")


@query("select event_type, count(*) as records, (max(epoch_us(ts)) // 1000 - min(epoch_us(ts)) // 1000) as ms, count(*) * 1000 // (max(epoch_us(ts)) // 1000 - min(epoch_us(ts)) // 1000) as per_second from events group by event_type")
def throughput(s, d):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return stats.rate(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("records"), (F.max(at) - F.min(at)).alias("ms")))


@query("select event_id, event_type, s as subscriber from events, (select unnest(range(0, 3)) as s) where event_id % 3 = s or s = 0")
def fanout_copies(s, d):
    subs = table(s, d, "events").select("event_type").distinct().crossJoin(F.broadcast(s.range(3).withColumnRenamed("id", "subscriber")))
    return stats.fan_out(table(s, d, "events").select("event_id", "event_type"), subs, "event_type").where("subscriber = 0 or event_id % 3 = subscriber")


@query("select o_orderkey, 'b' as side from orders where o_orderkey % 1000 = 1")
def batch_equality(s, d):
    o = table(s, d, "orders").select("o_orderkey")
    return stats.same_rows(o.where("o_orderkey % 1000 <> 1"), o)


@query("select distinct s_nationkey as node from supplier where s_nationkey <> 3 union select 99")
def node_set(s, d):
    nodes = table(s, d, "supplier").select(F.col("s_nationkey").cast("int").alias("node"))
    return nodes.union(s.range(1).select(F.lit(99).alias("node"))).distinct().subtract(s.range(1).select(F.lit(3).alias("node")))


@query("select event_type, event_id from (select *, row_number() over (partition by event_type order by event_id desc) as n from events) where n <= 10")
def retention_newest(s, d):
    return newest(table(s, d, "events"), ["event_type"], "event_id", 10).select("event_type", "event_id")


@query("""with recursive r as materialized (select user_id % 7 as link, event_id as ord, (20 + event_id % 30)::double as rtt_ms, row_number() over (partition by user_id % 7 order by event_id) as n from events),
f as (select link, ord, n, rtt_ms, rtt_ms as base_ms, case when rtt_ms - rtt_ms > 10 then 10::double * 0.85::double else 11::double end as "window" from r where n = 1 union all
  select r.link, r.ord, r.n, r.rtt_ms, least(f.base_ms, r.rtt_ms), case when r.rtt_ms - least(f.base_ms, r.rtt_ms) > 10 then greatest(1::double, f."window" * 0.85::double) else least(4096::double, f."window" + 1) end
  from f join r on r.link = f.link and r.n = f.n + 1)
select link, ord, rtt_ms, base_ms, "window" from f""")
def link_windows(s, d):
    r = table(s, d, "events").select((F.col("user_id") % 7).alias("link"), F.col("event_id").alias("ord"), (20 + F.col("event_id") % 30).cast("double").alias("rtt_ms"))
    return stats.window_trace(r)


@query("select event_id % 7 as link, event_id as ord, min(20 + event_id % 30) over (partition by event_id % 7 order by event_id) as base from events")
def least_round_trip(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events").select((F.col("event_id") % 7).alias("link"), F.col("event_id").alias("ord"), (20 + F.col("event_id") % 30).alias("rtt"))
    return e.select("link", "ord", F.min("rtt").over(Window.partitionBy("link").orderBy("ord")).alias("base"))


@query("select page_id, url_encode(url) as key from pages")
def blob_keys(s, d):
    return table(s, d, "pages").select("page_id", F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")).alias("key"))


@query("select event_type as topic, user_id % 3 as partition, count(*) as latest from events where event_type <> 'error' group by all")
def broker_produce(s, d):
    """Two rounds of produce through the service; a partition with a bad record is refused as a whole."""
    r = records(s, d)
    service = broker.Broker.empty(s, contract.Contract(64, b"evt:"))
    bad = r.where("topic = 'error'").withColumn("value", F.lit("no prefix"))
    for part in (r.where("topic <> 'error' and arrival % 2 = 0").unionByName(bad), r.where("topic <> 'error' and arrival % 2 = 1")):
        service, _ = service.produce(part)
    return log.bounds(service.log).select("topic", "partition", "latest")


@query("select topic, partition, case when topic = 'error' then 87 else 0 end as code from (select distinct event_type as topic, user_id % 3 as partition from events)")
def broker_outcomes(s, d):
    r = records(s, d).withColumn("value", F.expr("if(topic = 'error', 'no prefix', value)"))
    return broker.Broker.empty(s, contract.Contract(64, b"evt:")).produce(r)[1].select("topic", "partition", "code")


@query("select * from (values (0, 0, 7), (1, 0, 4), (2, 0, 2), (3, 0, 1), (8, 0, 2), (9, 0, 2), (10, 0, 2), (11, 1, 4), (12, 0, 2), (13, 0, 2), (14, 0, 2), (17, 0, 1), (18, 0, 3), (22, 0, 1), (24, 0, 1), (25, 0, 1), (26, 0, 1), (28, 0, 1), (36, 0, 1)) t(api, least, most)")
def api_versions(s, d):
    return broker.api_versions(s)


@query(f"select stream, arrival, seq from {ARRIVALS} where (arrival * 31 + 7) % 10 >= 3")
def lossy_link(s, d):
    return faults.dropped(arrivals(s, d), F.expr("(arrival * 31 + 7) % 10 < 3")).select("stream", "arrival", "seq")


@query(f"select stream, count(*) as sent, count(*) as committed from {ARRIVALS} group by stream")
def fault_storm(s, d):
    """Records dropped, repeated and reordered until all are acknowledged: each is committed once."""
    sent = arrivals(s, d).withColumn("key", F.concat(F.col("stream").cast("string"), F.lit("/"), F.col("seq").cast("string")))
    done = admit.admit(faults.storm(sent, rounds=4).select("stream", "arrival", "seq", "key")).where("disposition = 'Delivered'")
    return sent.groupBy("stream").agg(F.count("*").alias("sent")).join(done.groupBy("stream").agg(F.count("*").alias("committed")), "stream")
