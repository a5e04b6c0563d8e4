"""Registered queries of what the engine does as a service: codecs and envelopes as bytes, offload, transactions, proofs that
can be shown, maintenance of logs. Each stands beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, hashing
from ..operators import admit, contract, envelope, erasure, log, offload, offsets, proof, replicated, routing, stats, txn
from ..operators.ranking import positions, running_total
from . import faults
from .queries import COMMITS, LATEST, LEAVES, M64, commits, leaves, query
from .tables import ARRIVALS, LOG, RECORDS, arrivals, logged, records, table

CONTRACT = contract.Contract(64, b"evt:")
DATA_KEY, SIGNING_KEY, ROUTE = b"k" * 32, b"s" * 32, b"route-0000000001"


def hmac_sql(key: bytes, message: str) -> str:
    """HMAC-SHA-256 from two digests. message: SQL of the bytes."""
    inner, outer = ("".join(f"{b ^ m:02x}" for b in key.ljust(64, b"\0")) for m in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || {message})))"


def le64_sql(number: str) -> str:
    return "from_hex(printf('" + "%02x" * 8 + "', " + ", ".join(f"({number} >> {8 * i}) & 255" for i in range(8)) + "))"


# Codecs and envelopes as bytes


@query(f"select batch_id, batch_id % 5 as codec, n as sent, n as received, 0 as error, same from (select arrival // 40 as batch_id, count(*)::int as n, true as same from {RECORDS} group by 1)")
def record_batch_codecs(s, d):
    """Batches in each codec, read again: all values come back, in order."""
    b = records(s, d).withColumn("batch_id", F.expr("arrival div 40")).groupBy("batch_id").agg(F.array_sort(F.collect_list(F.col("value").cast("binary"))).alias("values"))
    wire = b.withColumn("codec", F.col("batch_id") % 5).withColumn("got", codec.decode_batch(codec.encode_compressed("values", "codec")))
    return wire.select("batch_id", "codec", F.size("values").alias("sent"), F.size("got.values").alias("received"), "got.error", (F.col("got.values") == F.col("values")).alias("same"))


def sealed(s, d, size: int = 10):
    """Envelopes of up to so many records: a topic is a stream, a batch's place in it the sequence number."""
    rows = positions(records(s, d), ["topic"], "arrival", "pos").withColumn("batch", F.struct("topic", F.expr(f"pos div {size}").alias("n")))
    framed = envelope.framed(rows, "batch", "arrival", "value").select("batch.topic", "batch.n", "records", "payload")
    return envelope.seal(framed, CONTRACT, DATA_KEY, SIGNING_KEY, ROUTE, F.col("topic"), F.col("n"), F.concat_ws("/", "topic", "n"), F.col("payload"))


BATCHES = f"(select topic, pos // 10 as n, count(*)::int as records from (select *, row_number() over (partition by topic order by arrival) - 1 as pos from {RECORDS}) group by all)"


@query(f"select topic, n, case when n % 7 in (1, 2, 3) then 'malformed' when n % 7 = 4 then 'bad_seal' else 'opened' end as outcome, case when n % 7 not in (1, 2, 3, 4) then records end as opened from {BATCHES}")
def envelope_bytes_roundtrip(s, d):
    """Envelopes encoded, some cut off, lengthened, of another version or with a changed payload, decoded and opened."""
    kind = F.col("n") % 7
    wire = sealed(s, d).withColumn("payload", F.when(kind == 4, F.concat(F.lit(b"?"), "payload")).otherwise(F.col("payload"))).withColumn("wire", envelope.encoded())
    size = F.octet_length("wire")
    bad = F.when(kind == 1, F.substring("wire", F.lit(1), size - 1)).when(kind == 2, F.concat("wire", F.lit(b"\0"))).when(kind == 3, F.concat(F.lit(b"\x02"), F.substring("wire", F.lit(2), size))).otherwise(F.col("wire"))
    got = envelope.decoded(wire.select("topic", "n", bad.alias("wire")))
    opened = envelope.opened(got.select("topic", "n", "envelope", "envelope.*"), CONTRACT, DATA_KEY, SIGNING_KEY, ROUTE)
    return opened.select("topic", "n", F.when(F.col("envelope").isNull(), "malformed").otherwise(F.coalesce("reason", F.lit("opened"))).alias("outcome"), F.size("values").alias("opened"))


@query(f"select topic, n, records, n % 3 = 0 as refused from {BATCHES}")
def forged_envelopes(s, d):
    """Envelopes under another's seal are refused, all others opened."""
    opened = envelope.opened(faults.forged(sealed(s, d), F.col("n") % 3 == 0), CONTRACT, DATA_KEY, SIGNING_KEY, ROUTE)
    return opened.select("topic", "n", "records", (F.coalesce("reason", F.lit("")) == "bad_seal").alias("refused"))


OFFLOADED = f"""(select topic, n, 0 as copy, records, case when n % 5 = 0 then 'DeadLettered' else 'Delivered' end as disposition, case when n % 5 = 0 then 'bad_seal' end as reason from {BATCHES}
  union all select topic, n, 1, records, case when n % 5 = 0 then 'Delivered' else 'Duplicate' end, null from {BATCHES} where n % 3 = 0)"""


@query(f"select topic, n, copy, disposition, reason, case when disposition = 'Delivered' then records end as landed from {OFFLOADED}")
def offload_outcomes(s, d):
    """Envelopes arrive, some damaged, some twice: each good one is delivered once, though its first copy was damaged."""
    once = sealed(s, d).withColumn("copy", F.lit(0)).withColumn("payload", F.when(F.col("n") % 5 == 0, F.concat("payload", F.lit(b"?"))).otherwise(F.col("payload")))
    both = once.unionByName(sealed(s, d).where("n % 3 = 0").withColumn("copy", F.lit(1))).withColumn("arrival", F.col("copy") * 1_000_000 + F.col("n"))
    done = offload.offload(both, CONTRACT, DATA_KEY, SIGNING_KEY, ROUTE)
    return done.select("topic", "n", "copy", "disposition", "reason", F.size("values").alias("landed"))


# Keys, certificates, tokens


@query(f"select c_custkey, {hmac_sql(b'master', "('kdf' || c_custkey)::blob")} as key from customer")
def derived_keys(s, d):
    return table(s, d, "customer").select("c_custkey", hashing.hmac_sha256(b"master", F.concat(F.lit("kdf"), F.col("c_custkey").cast("string"))).alias("key"))


@query("""select c_custkey, case when c_custkey % 11 = 0 then 'malformed' when c_custkey % 7 = 0 then 'signature' when c_custkey % 5 = 0 then 'subject' when c_custkey % 4 = 0 then 'epoch' end as failure from customer""")
def sender_certificates(s, d):
    """Certificates, some cut off, forged, of another sender or of an epoch that has passed."""
    c, name = table(s, d, "customer"), F.col("c_name")
    epoch = F.when(F.col("c_custkey") % 4 == 0, 2).otherwise(3)
    subject = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("not "), name)).otherwise(name)
    cert = F.when(F.col("c_custkey") % 7 == 0, envelope.certificate(b"other", subject, epoch)).otherwise(envelope.certificate(SIGNING_KEY, subject, epoch))
    cert = F.when(F.col("c_custkey") % 11 == 0, F.substring(cert, 1, 72)).otherwise(cert)
    return c.select("c_custkey", envelope.certificate_failure(cert, SIGNING_KEY, name, 3).alias("failure"))


MARKS = f"(select stream, coalesce(min(case when seq <> n then n end), count(*)) as low_watermark from (select stream, seq, row_number() over (partition by stream order by seq) - 1 as n from {ARRIVALS} where arrival % 17 <> 3) group by stream)"


@query(f"select stream, low_watermark, {hmac_sql(b'token-key', f"'watermark'::blob || {le64_sql('low_watermark')} || stream::varchar::blob")} as token, true as holds, false as holds_for_another from {MARKS}")
def watermark_tokens(s, d):
    marks = admit.contiguous_watermark(arrivals(s, d).where("arrival % 17 <> 3"))
    stream = F.col("stream").cast("string")
    signed = marks.withColumn("token", admit.signed_watermark(b"token-key", stream, F.col("low_watermark")))
    holds = lambda mark: admit.watermark_ok(b"token-key", stream, mark, F.col("token"))
    return signed.select("stream", "low_watermark", "token", holds(F.col("low_watermark")).alias("holds"), holds(F.col("low_watermark") + 1).alias("holds_for_another"))


@query(f"select s_suppkey, {hmac_sql(b'cookie-key', "(s_name || '/' || s_suppkey // 5)::blob")} as cookie, s_suppkey % 3 <> 0 as valid from supplier")
def address_cookies(s, d):
    """A cookie is bound to an address and a time slice: from another address it isn't valid."""
    own = F.concat_ws("/", "s_name", F.expr("cast(s_suppkey div 5 as string)"))
    back = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("!"), own)).otherwise(own)
    return table(s, d, "supplier").select("s_suppkey", hashing.hmac_sha256(b"cookie-key", own).alias("cookie"), (hashing.hmac_sha256(b"cookie-key", own) == hashing.hmac_sha256(b"cookie-key", back)).alias("valid"))


# Receipts and chunks


@query(f"""select log_id, idx, case idx % 8 when 0 then 'content' when 1 then 'head' when 2 then 'tree_size' when 3 then 'inclusion' when 4 then 'ack' when 5 then 'ack_position' when 6 then 'ack_root' end as failure from {LEAVES}""")
def receipt_checks(s, d):
    """Receipts with one part of each changed: the check that names this part fails."""
    l, key = leaves(s, d), SIGNING_KEY
    kind, wrong = F.col("idx") % 8, F.unhex(F.sha2(F.lit("wrong"), 256))
    r = proof.receipts(l, key)
    other = lambda k, value, name: F.when(kind == k, value).otherwise(F.col(name)).alias(name)
    size = F.when(kind == 2, F.col("idx")).otherwise(F.col("size"))
    ack = lambda idx, root: F.unhex(proof.acknowledgement(key, F.col("hash"), idx, root))
    r = r.select(
        "log_id", "idx", "hash", size.alias("size"), "root", F.when(kind == 1, wrong).when(kind == 2, F.unhex(proof.tree_head(key, F.col("log_id"), size, F.col("root")))).otherwise(F.col("head")).alias("head"),
        F.when(kind == 3, F.transform("path", lambda x: x.withField("right", ~x["right"]))).otherwise(F.col("path")).alias("path"), other(5, F.col("idx") + 1, "ack_idx"), other(6, wrong, "ack_root"),
        F.when(kind == 4, wrong).when(kind == 5, ack(F.col("idx") + 1, F.col("root"))).when(kind == 6, ack(F.col("idx"), wrong)).otherwise(F.col("ack")).alias("ack"),
    )
    want = l.select("log_id", "idx", F.when(kind == 0, wrong).otherwise(F.col("hash")).alias("sent"))
    told = proof.verified(r.join(want.hint("merge"), ["log_id", "idx"]), key, F.col("sent"))
    return told.select("log_id", "idx", "failure")


@query(f"""with recursive n as (select log_id, count(*) as size from {LEAVES} group by log_id), w as (select log_id, 0 as depth, size as width from n union all select log_id, depth + 1, (width + 1) // 2 from w where width > 1)
select l.log_id, l.idx, count(*) filter (where w.width > 1 and xor(l.idx >> w.depth, 1) < w.width)::int as steps, count(*) filter (where w.width > 1 and (l.idx >> w.depth) % 2 = 1)::int as lefts from {LEAVES} l join w using (log_id) group by all""")
def inclusion_paths(s, d):
    """How many siblings stand on each leaf's way to its root, and how many of them on the left."""
    p = proof.inclusion_proofs(leaves(s, d))
    return p.select("log_id", "idx", F.size("path").alias("steps"), F.size(F.filter("path", lambda x: ~x["right"])).alias("lefts"))


@query("select doc_id, count(*) filter (where (doc_id + i) % 4 <> 0) as accepted, count(*) as total from (select doc_id, unnest(range(0, greatest((octet_length(encode(text)) + 999) // 1000, 1))) as i from documents) group by doc_id")
def chunk_verify(s, d):
    """Pieces against the leaves of their blob: a changed piece isn't taken, one that comes twice is taken once."""
    pieces = proof.chunks(table(s, d, "documents"), "doc_id", "text", 1000)
    known = pieces.select("doc_id", "idx", proof.chunk_leaf(F.col("idx"), F.col("bytes")).alias("leaf"))
    sent = pieces.withColumn("bytes", F.when((F.col("doc_id") + F.col("idx")) % 4 == 0, F.concat("bytes", F.lit(b"?"))).otherwise(F.col("bytes")))
    taken = proof.accepted_chunks(sent.unionAll(sent.where("idx % 2 = 0")), known, "doc_id").groupBy("doc_id").agg(F.count("*").alias("accepted"))
    return pieces.groupBy("doc_id").agg(F.count("*").alias("total")).join(taken, "doc_id", "left").select("doc_id", F.coalesce("accepted", F.lit(0)).alias("accepted"), "total")


# Transactions as a service


def service_events(s, d):
    kinds = F.array(*map(F.lit, ("init", "add", "buffer", "add", "buffer", "buffer", "end", "buffer")))
    e = table(s, d, "events").select(
        F.col("event_id").alias("ord"), F.get(kinds, F.expr("cast((event_id * 7 + event_id div 13) % 8 as int)")).alias("kind"), (F.col("user_id") % 9).cast("string").alias("transactional_id"), F.lit("t").alias("topic"),
        (F.col("event_id") % 2).alias("partition"), F.when(F.col("event_id") % 19 == 0, "bad").otherwise(F.concat(F.lit("evt:"), F.col("event_id").cast("string"))).alias("value"), (F.col("event_id") % 3 != 0).alias("commit"),
    )
    inits = running_total(e, ["transactional_id"], "ord", (F.col("kind") == "init").cast("long"), "before")
    now = F.col("before") + (F.col("kind") == "init").cast("long") - 1
    return inits.withColumn("epoch", now - (F.col("ord") % 17 == 0).cast("long")).drop("before")


SERVICE = """(select *, sum(case when kind = 'init' then 1 else 0 end) over (partition by transactional_id order by ord) - 1 as now, now - (case when ord % 17 = 0 then 1 else 0 end) as epoch from
  (select event_id as ord, ['init', 'add', 'buffer', 'add', 'buffer', 'buffer', 'end', 'buffer'][(event_id * 7 + event_id // 13) % 8 + 1] as kind, (user_id % 9)::varchar as transactional_id, event_id % 2 as partition, event_id % 19 = 0 as bad, event_id % 3 <> 0 as commit from events))"""
#: For each event the last one before it that closed the id's transaction, that opened it, and that claimed its partition.
STATE = f"""with e as (select *, kind = 'init' or epoch = now as ok from {SERVICE}),
s as (select *, coalesce((select max(x.ord) from e x where x.transactional_id = e.transactional_id and x.ord < e.ord and x.ok and x.kind in ('init', 'end')), -1) as closed,
  coalesce((select max(x.ord) from e x where x.transactional_id = e.transactional_id and x.ord < e.ord and x.ok and x.kind = 'add'), -1) as opened,
  coalesce((select max(x.ord) from e x where x.transactional_id = e.transactional_id and x.ord < e.ord and x.ok and x.kind = 'add' and x.partition = e.partition), -1) as claimed from e),
c as (select *, case when kind = 'init' then 0 when not ok then 47 when kind = 'end' and opened <= closed then 48 when kind = 'buffer' and (opened <= closed or claimed <= closed) then 48 when kind = 'buffer' and bad then 87 else 0 end as code from s)"""


@query(f"{STATE} select ord, transactional_id, kind, code::int as code from c")
def broker_transactions(s, d):
    """The answers of the transactional service to inits, claims, records and ends, some of an older epoch."""
    return txn.served(service_events(s, d), CONTRACT).select("ord", "transactional_id", "kind", "code")


@query(f"""{STATE}, ends as (select transactional_id, ord, kind = 'end' and commit as commits from c where kind = 'init' or kind = 'end' and code = 0),
staged as (select c.*, (select min(ord) from ends where ends.transactional_id = c.transactional_id and ends.ord > c.ord) as until from c where kind = 'buffer' and code = 0)
select st.ord, st.transactional_id, st.partition, (row_number() over (partition by st.transactional_id, st.closed, st.partition order by st.ord) - 1)::int as provisional, coalesce(e.commits, false) as shown
from staged st left join ends e on e.transactional_id = st.transactional_id and e.ord = st.until""")
def broker_visible(s, d):
    """Staged records with their places, and whether the transaction that holds them is committed."""
    done = txn.served(service_events(s, d), CONTRACT)
    return done.where("kind = 'buffer' and code = 0").select("ord", "transactional_id", "partition", "provisional", "shown")


# Maintenance


@query(f'select "group", "partition", arg_max("offset", ord) as "offset", max(ord) as ord from {COMMITS} group by all')
def commits_compacted(s, d):
    return offsets.compacted(commits(s, d), ["group", "partition"])


@query(f'select n.g as "group", n.p as "partition", committed from (select unnest([\'1-URGENT\', \'3-MEDIUM\', \'nobody\']) as g, p from (select unnest(range(0, 5)) as p)) n left join {LATEST} l on l."group" = n.g and l."partition" = n.p')
def offset_snapshot(s, d):
    names = s.range(5).select(F.col("id").alias("partition"), F.explode(F.array(*map(F.lit, ("1-URGENT", "3-MEDIUM", "nobody")))).alias("group"))
    return offsets.snapshot(names, offsets.latest(commits(s, d), ["group", "partition"]), ["group", "partition"])


@query('select o_orderkey as ord, case when o_orderkey % 9 not in (0, 1) then o_orderpriority end as "group", case when o_orderkey % 9 not in (0, 1) then (o_custkey % 3)::int end as partition, case when o_orderkey % 9 not in (0, 1) then o_orderkey end as "offset" from orders')
def offset_records(s, d):
    """Commits as bytes, some cut off, some with a byte too many, parsed again."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), offsets.record_bytes(F.col("o_orderpriority"), F.lit("t"), F.col("o_custkey") % 3, F.col("o_orderkey")).alias("raw"))
    cut = F.when(F.col("ord") % 9 == 0, F.substring("raw", F.lit(1), F.octet_length("raw") - 1)).when(F.col("ord") % 9 == 1, F.concat("raw", F.lit(b"\0"))).otherwise(F.col("raw"))
    return o.select("ord", offsets.parsed(cut).alias("p")).select("ord", "p.group", "p.partition", "p.offset")


@query(f'select topic, "partition", sum(octet_length(value::blob) + 8)::bigint as "end" from {LOG} group by all')
def topic_end(s, d):
    return log.end_offset(logged(s, d))


@query(f"select topic, partition, arrival, md5(value) as md5 from (select *, row_number() over (partition by topic, partition order by arrival) - 1 as pos from {RECORDS})")
def replicated_topic(s, d):
    """Records kept as shards, two of the six of each lost, and put together again by offset."""
    rows, code = records(s, d), erasure.Code(4, 2)
    shards = replicated.produce(rows.select("topic", "partition", "arrival", "value"), code)
    left = shards.where((F.col("idx") != F.col("offset") % 6) & (F.col("idx") != (F.col("offset") + 1 + F.col("offset") % 5) % 6))
    back = replicated.reconstruct(left, code).join(logged(s, d).select("topic", "partition", "offset", "arrival"), ["topic", "partition", "offset"])
    return back.select("topic", "partition", "arrival", F.md5("value").alias("md5"))


# Links and small parts


@query(f"select stream, count(*) as sent, count(*) filter (where seq % 9 = 8) as lost, min(20 + arrival % 30) as base_rtt from {ARRIVALS} group by stream")
def link_loss(s, d):
    """A link that loses every ninth of a stream's sends: how many, and the least round trip."""
    sent = log.link_faults(records(s, d).withColumn("rtt", 20 + F.col("arrival") % 30), ["stream"], "arrival", 9)
    return sent.groupBy("stream").agg(F.count("*").alias("sent"), F.count_if("lost").alias("lost"), F.min("rtt").alias("base_rtt"))


@query("select event_id, user_id as stream from events where event_id % 4 <> 0 and 10000 - event_id >= 200 + event_id % 5000")
def retransmit_due(s, d):
    e = table(s, d, "events").select("event_id", F.col("user_id").alias("stream"), F.col("event_id").alias("last_tx"), (F.col("event_id") % 4 == 0).alias("acked"))
    return log.retransmits(e, F.lit(10_000), 200 + F.col("event_id") % 5000).select("event_id", "stream")


@query("select distinct event_type as topic, user_id % 3 as partition, event_id % 5 as producer, 2 as epoch from events")
def stream_identities(s, d):
    e = table(s, d, "events")
    key = envelope.stream_identity(F.lit(ROUTE), F.col("event_type"), F.col("user_id") % 3, F.col("event_id") % 5, F.lit(2))
    return e.select(key.alias("k")).distinct().select("k.topic", "k.partition", "k.producer", "k.epoch")


@query("select doc_id, doc_id % 3 = 0 as has_nul from documents")
def nul_guard(s, d):
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit("\0"))).otherwise(F.translate(F.coalesce(F.col("text"), F.lit("")), "\0", ""))
    return table(s, d, "documents").select("doc_id", contract.has_nul(made).alias("has_nul"))


@query(f"""with n as (select o_orderkey as id, o_orderkey::ubigint as a from orders), b as (select id, (xor(a, a >> 33)::uhugeint * 18397679294719823053::uhugeint % {M64})::ubigint as a from n), c as (select id, (xor(a, a >> 33)::uhugeint * 14181476777654086739::uhugeint % {M64})::ubigint as a from b)
select id, printf('%016x', xor(a, a >> 33)) as key from c""")
def uniform_keys(s, d):
    return routing.uniform_keys(table(s, d, "orders").select(F.col("o_orderkey").alias("id"))).select("id", "key")


@query("select page_id, regexp_extract(name, '^([0-9a-f]+)/([0-9]{20})[.]env$', 1) as stream, regexp_extract(name, '^([0-9a-f]+)/([0-9]{20})[.]env$', 2)::bigint as seq from (select page_id, case when page_id % 4 = 0 then 'x/' || page_id || '.env' else lower(hex(url)) || '/' || printf('%020d', page_id) || '.env' end as name from pages) where page_id % 4 <> 0")
def object_keys(s, d):
    """Names of stored envelopes parsed to stream and number; other names are left out."""
    name = F.when(F.col("page_id") % 4 == 0, F.format_string("x/%d.env", "page_id")).otherwise(F.concat(F.lower(F.hex(F.col("url").cast("binary"))), F.lit("/"), F.format_string("%020d", "page_id"), F.lit(".env")))
    return log.object_names(table(s, d, "pages").select("page_id", name.alias("name")), "name").select("page_id", "stream", "seq")


@query(f"""with recursive l as materialized (select topic, us, row_number() over (partition by topic order by arrival) as n from (select event_type as topic, event_id as arrival, event_id * 37 as us from events)),
f as (select topic, n, us, us as began, 1 as held, 0 as batch from l where n = 1 union all
  select l.topic, l.n, l.us, case when f.held >= 8 or l.us - f.began >= 900 then l.us else f.began end, case when f.held >= 8 or l.us - f.began >= 900 then 1 else f.held + 1 end, case when f.held >= 8 or l.us - f.began >= 900 then f.batch + 1 else f.batch end
  from f join l on l.topic = f.topic and l.n = f.n + 1)
select topic, us, batch::bigint as batch from f""")
def count_or_time_batches(s, d):
    """Records in batches that close at eight records or 900 microseconds after their first."""
    e = table(s, d, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("arrival"), (F.col("event_id") * 37).alias("us"))
    return stats.batched(e, ["topic"], "us", 8, 900).select("topic", "us", "batch")
