"""The registered queries over the driver's tables, each beside the same result as SQL for DuckDB.

How tables become keyspaces: orders and customer by their integer keys (tuple-packed where a key column is
shown, as upper-case hex), lineitem by (part), events as the mutation log: version = event_id,
key = user_id, an `error` clears the key, any other type sets it. Transactions are orders: txn and
version = o_orderkey, reading [o_custkey, o_custkey + 2) at a version 40 earlier, writing o_custkey, and
every fifth customer's orders write [o_custkey, o_custkey + 3).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import keys, tuples
from .operators import allocator, conflicts, directory, folds, overlay, ranges, routing, selectors, store
from .plans.keyspace import Keyspace
from .sources import log as logs, tools
from .sources.scratch import new_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Eight shards over the order keys and eight over the users, as (tag, end).
ORDER_SHARDS = [(i, 2**62 if i == 7 else 2000 * 2**i) for i in range(8)]
LAG = 40


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_kv(spark: SparkSession, d: str) -> DataFrame:
    """key: packed o_orderkey; value: the status' bytes; the integers stay beside them."""
    o = table(spark, d, "orders")
    return o.select(tuples.pack_int(F.col("o_orderkey")).alias("key"), F.col("o_orderstatus").cast("binary").alias("value"), "o_orderkey", "o_custkey")


def event_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cleared = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("k"), F.col("event_id").alias("version"), F.lit(0).alias("txn"), F.lit(0).alias("seq"), F.when(cleared, "clear").otherwise("set").alias("op"),
        F.when(~cleared, F.col("event_type")).alias("operand"), (F.col("user_id") % 8).cast("int").alias("tag"),
    )


def event_kv(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select(F.col("k").alias("key"), "version", F.col("operand").alias("value"))


def transactions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("txn"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") - LAG).alias("read_version"), F.col("o_custkey").alias("c"))
    reads = o.select("txn", "version", "read_version", F.col("c").alias("s"), (F.col("c") + 2).alias("e"))
    writes = o.select("txn", "version", F.col("c").alias("s"), (F.col("c") + F.when(F.col("c") % 5 == 0, 3).otherwise(1)).alias("e"))
    return reads, writes


_HEX_KEY = "CASE WHEN {0} = 0 THEN '14' ELSE printf('%02X', 20 + (length(hex({0})) + 1) // 2) || CASE WHEN length(hex({0})) % 2 = 1 THEN '0' ELSE '' END || hex({0}) END"
_ORDER_KEY = _HEX_KEY.format("o_orderkey")
_LOG = "(SELECT user_id AS k, event_id AS version, CASE WHEN event_type <> 'error' THEN event_type END AS value, user_id % 8 AS tag FROM events)"
_TXN = """r AS (SELECT o_orderkey AS txn, o_orderkey AS version, o_orderkey - 40 AS read_version, o_custkey AS s, o_custkey + 2 AS e FROM orders),
w AS (SELECT o_orderkey AS txn, o_orderkey AS version, o_custkey AS s, o_custkey + CASE WHEN o_custkey % 5 = 0 THEN 3 ELSE 1 END AS e FROM orders)"""
_TAG = "CASE " + " ".join(f"WHEN o_orderkey < {end} THEN {tag}" for tag, end in ORDER_SHARDS) + " END"


# Scans


@query(f"SELECT {_ORDER_KEY} AS key_hex, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 777")
def kv_point_get(spark, d):
    o = orders_kv(spark, d)
    return store.get(o, tuples.pack(777)).select(F.hex("key").alias("key_hex"), "o_custkey", F.col("value").cast("string").alias("o_orderstatus"))


@query("""WITH q AS (SELECT o_orderkey, o_custkey AS key FROM orders UNION ALL SELECT o_orderkey, -1 - o_custkey FROM orders)
SELECT q.o_orderkey, q.key, c.c_name AS found FROM q LEFT JOIN customer c ON c.c_custkey = q.key""")
def kv_multi_get(spark, d):
    """Each order asks for its customer and for a key that is not there."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    asked = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(F.col("o_custkey"), -1 - F.col("o_custkey"))).alias("key"))
    return store.multi_get(c, asked).select("o_orderkey", "key", "found")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000")
def kv_range_scan(spark, d):
    return table(spark, d, "orders").where(keys.contains(F.col("o_orderkey"), F.lit(1000), F.lit(5000))).select("o_orderkey", "o_custkey")


@query(f"SELECT {_ORDER_KEY} AS key_hex, o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 500000 ORDER BY o_orderkey LIMIT 100")
def kv_range_limit(spark, d):
    o = orders_kv(spark, d)
    found = store.get_range(o, tuples.pack(1000), tuples.pack(500000), 100)
    return found.select(F.hex("key").alias("key_hex"), tuples.unpack_int(F.col("key"), F.lit(1)).alias("o_orderkey"), "o_custkey")


@query(f"SELECT '{tuples.pack(42).hex().upper()}' || {_ORDER_KEY} AS key_hex, o_orderkey FROM orders WHERE o_custkey = 42")
def kv_prefix_scan(spark, d):
    o = table(spark, d, "orders").select(tuples.pack_columns(tuples.pack_int(F.col("o_custkey")), tuples.pack_int(F.col("o_orderkey"))).alias("key"), F.lit(bytearray(b"")).alias("value"))
    inside = Keyspace(decode_key=lambda k: tuples.unpack_int(k, F.lit(1))).add(42).scan(o)
    return inside.select(F.hex(F.concat(F.lit(bytearray(tuples.pack(42))), tuples.pack_int(F.col("key")))).alias("key_hex"), F.col("key").alias("o_orderkey"))


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS c FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400)
SELECT o_orderkey, c > 50 AS has_more FROM p WHERE n <= 50""")
def kv_has_more(spark, d):
    return store.page(orders_kv(spark, d), tuples.pack(100), tuples.pack(400), 50).select("o_orderkey", "has_more")


@query("SELECT n_regionkey AS region, n_nationkey AS nation, n_name AS name FROM nation WHERE n_regionkey = 2")
def keyspace_scan_decode(spark, d):
    n = table(spark, d, "nation")
    kv = n.select(tuples.pack_columns(tuples.pack_bytes(F.lit("nation")), tuples.pack_int(F.col("n_regionkey")), tuples.pack_int(F.col("n_nationkey"))).alias("key"), F.col("n_name").cast("binary").alias("value"))
    space = Keyspace(decode_key=lambda k: tuples.unpack_int(k, F.lit(1)), decode_value=lambda v: v.cast("string")).add("nation", 2)
    return space.scan(kv).select(F.lit(2).alias("region"), F.col("key").cast("int").alias("nation"), F.col("value").alias("name"))


@query(f"SELECT o_custkey, o_orderkey, {_HEX_KEY.format('o_custkey')} || {_ORDER_KEY} AS key_hex, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders")
def tuple_pack_order(spark, d):
    from pyspark.sql import Window

    key = tuples.pack_columns(tuples.pack_int(F.col("o_custkey")), tuples.pack_int(F.col("o_orderkey")))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", key.alias("key"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("key")).cast("long")
    return o.select("o_custkey", "o_orderkey", F.hex("key").alias("key_hex"), place.alias("place"))


@query("SELECT c_custkey, '01' || hex(c_name) || '00' AS key_hex FROM customer")
def tuple_pack_strings(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.hex(tuples.pack_bytes(F.col("c_name"))).alias("key_hex"))


@query("SELECT s_suppkey, CAST(-s_suppkey AS BIGINT) AS negative FROM supplier")
def tuple_round_trip(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", tuples.pack_int(-F.col("s_suppkey")).alias("key"))
    return s.select("s_suppkey", tuples.unpack_int(F.col("key"), F.lit(1)).alias("negative"))


@query("SELECT o_orderkey, hex(o_orderstatus) || '00' AS after_hex, printf('%02X', ascii(o_orderstatus) + 1) AS next_hex FROM orders")
def key_successors(spark, d):
    """Of every order, with those whose successor carries into the upper half of the byte."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").cast("binary").alias("k"))
    return o.select("o_orderkey", F.hex(keys.key_after_col(F.col("k"))).alias("after_hex"), F.hex(keys.strinc_col(F.col("k"))).alias("next_hex"))


# Ranges


@query("""WITH p AS (SELECT p_brand AS b, p_partkey AS id, p_partkey AS s, p_partkey + p_size AS e FROM part)
SELECT x.id AS left_id, y.id AS right_id FROM p x JOIN p y ON x.b = y.b AND x.id < y.id AND x.s < y.e AND y.s < x.e""")
def key_range_overlap(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_partkey").alias("s"), (F.col("p_partkey") + F.col("p_size")).alias("e"))
    a = p.select("p_brand", F.col("id").alias("left_id"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = p.select("p_brand", F.col("id").alias("right_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return ranges.overlap_join(a, b, ["p_brand"], ("s1", "e1"), ("s2", "e2"), 64).where("left_id < right_id").select("left_id", "right_id")


@query("""WITH m AS (SELECT o_custkey, o_orderkey AS s, o_orderkey + 500 AS e, max(o_orderkey + 500) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT o_custkey, min(s) AS s, max(e) AS e FROM i GROUP BY o_custkey, g""")
def key_range_coalesce(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + 500).alias("e"))
    return ranges.coalesce_ranges(o, ["o_custkey"])


@query("""WITH p AS (SELECT p_brand AS b, p_partkey AS id, p_partkey AS s, p_partkey + p_size AS e FROM part),
c AS (SELECT DISTINCT b, s AS x FROM p UNION SELECT DISTINCT b, e FROM p), g AS (SELECT b, x AS s, lead(x) OVER (PARTITION BY b ORDER BY x) AS e FROM c)
SELECT g.b AS p_brand, g.s, g.e, count(DISTINCT p.id) AS members FROM g JOIN p ON g.b = p.b AND g.s < p.e AND p.s < g.e WHERE g.e IS NOT NULL GROUP BY ALL""")
def keyspace_segments(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_partkey").alias("s"), (F.col("p_partkey") + F.col("p_size")).alias("e"))
    return ranges.segments(p, ["p_brand"], "id").select("p_brand", "s", "e", F.size("members").cast("long").alias("members"))


# Key selectors


def _selector(kind: str, offset: int = 0):
    def run(spark, d):
        o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
        probes = table(spark, d, "customer").select((F.col("c_custkey") * 7).alias("probe"), F.lit(kind).alias("kind"), F.lit(offset).alias("offset"))
        return selectors.resolve(o, probes).select("probe", "found")

    return run


for _name, _kind, _sql in (
    ("selector_first_ge", "first_greater_or_equal", "min(o_orderkey) FROM orders WHERE o_orderkey >= c_custkey * 7"),
    ("selector_first_gt", "first_greater_than", "min(o_orderkey) FROM orders WHERE o_orderkey > c_custkey * 7"),
    ("selector_last_le", "last_less_or_equal", "max(o_orderkey) FROM orders WHERE o_orderkey <= c_custkey * 7"),
    ("selector_last_lt", "last_less_than", "max(o_orderkey) FROM orders WHERE o_orderkey < c_custkey * 7"),
):
    QUERIES[_name] = _selector(_kind)
    ORACLE_SQL[_name] = f"SELECT c_custkey * 7 AS probe, (SELECT {_sql}) AS found FROM customer"
QUERIES["selector_offset"] = _selector("first_greater_or_equal", 10)
ORACLE_SQL["selector_offset"] = """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
p AS (SELECT c_custkey * 7 AS probe, (SELECT min(n) FROM r WHERE o_orderkey >= c_custkey * 7) + 10 AS n FROM customer)
SELECT probe, o_orderkey AS found FROM p LEFT JOIN r USING (n)"""


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE o_orderkey > 400) AND o_orderkey < (SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= 900)")
def selector_range(spark, d):
    o = orders_kv(spark, d)
    found = selectors.range_between(o, selectors.first_greater_than(tuples.pack(400)), selectors.last_less_or_equal(tuples.pack(900)))
    return found.select("o_orderkey", "o_custkey")


# Versions


@query(f"SELECT k AS key, max(version) AS version, arg_max_null(value, version) AS value FROM {_LOG} GROUP BY k HAVING arg_max_null(value, version) IS NOT NULL")
def mvcc_latest(spark, d):
    return store.latest(event_kv(spark, d))


@query(f"SELECT k AS key, max(version) AS version, arg_max_null(value, version) AS value FROM {_LOG} WHERE version <= 5000 GROUP BY k HAVING arg_max_null(value, version) IS NOT NULL")
def mvcc_as_of(spark, d):
    return store.kv_at(event_kv(spark, d), 5000)


@query(f"""WITH h AS (SELECT k AS key, version, value, lag(value) OVER (PARTITION BY k ORDER BY version) AS before FROM {_LOG})
SELECT * FROM h WHERE version > 2000 AND version <= 8000""")
def mvcc_history(spark, d):
    return store.history(event_kv(spark, d), 2000, 8000).select("key", "version", "value", "before")


@query(f"""SELECT k AS key, version, value FROM {_LOG} WHERE version > 5000
UNION ALL SELECT k, max(version), arg_max_null(value, version) FROM {_LOG} WHERE version <= 5000 GROUP BY k HAVING arg_max_null(value, version) IS NOT NULL""")
def mvcc_gc(spark, d):
    return store.retain(event_kv(spark, d), 5000)


@query(f"SELECT k AS key, max(version) AS version FROM {_LOG} GROUP BY k HAVING arg_max_null(value, version) IS NULL")
def mvcc_tombstone(spark, d):
    return store.latest(event_kv(spark, d), keep_cleared=True).where("value is null").select("key", "version")


@query(f"SELECT count(*) AS entries, min(version) AS oldest, max(version) AS newest FROM {_LOG} WHERE version < 7000")
def mvcc_drop_from(spark, d):
    return store.drop_from(event_kv(spark, d), 7000).agg(F.count(F.lit(1)).alias("entries"), F.min("version").alias("oldest"), F.max("version").alias("newest"))


# Atomic operations


def _atomic(op: str):
    def run(spark, d):
        ops = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), keys.le_encode(F.col("l_quantity").cast("long"), 4).alias("operand"))
        return folds.commutative(ops, op, 4).select("key", F.col("n").alias("value"), F.hex("value").alias("value_hex"))

    return run


for _op, _agg in (("add", "sum"), ("min", "min"), ("max", "max"), ("bit_and", "bit_and"), ("bit_or", "bit_or"), ("bit_xor", "bit_xor")):
    QUERIES[f"atomic_{_op}"] = _atomic(_op)
    ORACLE_SQL[f"atomic_{_op}"] = f"""WITH t AS (SELECT l_partkey AS key, CAST({_agg}(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1)
SELECT key, value, printf('%02X%02X%02X%02X', value % 256, (value // 256) % 256, (value // 65536) % 256, (value // 16777216) % 256) AS value_hex FROM t"""


def _event_operands(spark, d):
    return event_log(spark, d).where("op = 'set'").select(F.col("k").alias("key"), "version", "txn", "seq", "op", F.col("operand").cast("binary").alias("operand"))


@query("SELECT user_id AS key, min(event_type) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def atomic_byte_min(spark, d):
    return folds.bytewise(_event_operands(spark, d), "byte_min").select("key", F.col("value").cast("string").alias("value"))


@query("SELECT user_id AS key, max(event_type) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def atomic_byte_max(spark, d):
    return folds.bytewise(_event_operands(spark, d), "byte_max").select("key", F.col("value").cast("string").alias("value"))


@query("SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def atomic_append_if_fits(spark, d):
    return folds.append_if_fits(_event_operands(spark, d)).select("key", F.col("value").cast("string").alias("value"))


@query("""WITH l AS (SELECT user_id, max(event_id) AS put, arg_max(event_type, event_id) AS v FROM events WHERE event_type <> 'error' GROUP BY 1),
e AS (SELECT user_id, max(event_id) AS err FROM events WHERE event_type = 'error' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id AS key, CASE WHEN v = 'click' AND err > put THEN NULL ELSE v END AS value FROM u LEFT JOIN l USING (user_id) LEFT JOIN e USING (user_id)""")
def atomic_compare_and_clear(spark, d):
    log = event_log(spark, d).select(F.col("k").alias("key"), "version", "txn", "seq", F.when(F.col("op") == "set", "set").otherwise("compare_and_clear").alias("op"), F.coalesce("operand", F.lit("click")).cast("binary").alias("operand"))
    return folds.compare_and_clear(log).select("key", F.col("value").cast("string").alias("value"))


@query("""WITH x AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'error') AS err FROM events GROUP BY 1)
SELECT e.user_id AS key, CAST(coalesce(sum(CASE WHEN event_id > coalesce(err, -1) THEN length(event_type) END), 0) AS BIGINT) AS value FROM events e JOIN x USING (user_id) GROUP BY 1
HAVING count(*) FILTER (WHERE event_id > coalesce(err, -1)) > 0""")
def atomic_general(spark, d):
    log = event_log(spark, d)
    adds = log.select(F.col("k").alias("key"), "version", "txn", "seq", F.when(F.col("op") == "set", "add").otherwise("clear").alias("op"), keys.le_encode(F.length(F.coalesce("operand", F.lit(""))).cast("long"), 6).alias("operand"))
    return folds.general(adds).where("value is not null").select("key", keys.le_decode(F.col("value")).alias("value"))


@query(f"""WITH t AS (SELECT version // 10 AS txn, k, version % 10 AS seq, value FROM {_LOG})
SELECT txn, k AS key, CAST(max(seq) AS BIGINT) AS seq, arg_max_null(value, seq) AS value FROM t GROUP BY 1, 2""")
def mutation_supersession(spark, d):
    log = event_log(spark, d).select((F.col("version") / 10).cast("long").alias("txn"), F.lit(0).alias("version"), F.col("k").alias("key"), (F.col("version") % 10).alias("seq"), "op", F.lit(None).cast("long").alias("end_key"), "operand")
    return folds.superseded(log).select("txn", "key", "seq", F.col("operand").alias("value"))


# Range clears, overlays


@query(f"""WITH s AS (SELECT k, max(version) AS version, arg_max(value, version) AS value FROM {_LOG} WHERE value IS NOT NULL GROUP BY k),
c AS (SELECT user_id AS s, user_id + 10 AS e, event_id AS cleared FROM events WHERE event_type = 'error')
SELECT k, version, value FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE k >= c.s AND k < c.e AND cleared > version)""")
def clear_range_apply(spark, d):
    log = event_log(spark, d)
    clears = log.where("op = 'clear'").select(F.col("k").alias("s"), (F.col("k") + 10).alias("e"), F.col("version").alias("at"))
    return ranges.apply_clears(log.where("op = 'set'").select("k", "version", F.col("operand").alias("value")), clears)


@query(f"""WITH s AS (SELECT k, max(version) AS version, arg_max(value, version) AS value FROM {_LOG} WHERE value IS NOT NULL GROUP BY k),
c AS (SELECT user_id AS s, user_id + 1 + event_id % 40 AS e, event_id AS cleared FROM events WHERE event_type = 'error')
SELECT {_HEX_KEY.format('k')} AS key_hex, version, value FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE k >= c.s AND k < c.e AND cleared > version)""")
def clear_range_binary(spark, d):
    """Range clears over packed keys, of every width from one key to forty."""
    log = event_log(spark, d)
    clears = log.where("op = 'clear'").select(tuples.pack_int(F.col("k")).alias("s"), tuples.pack_int(F.col("k") + 1 + F.col("version") % 40).alias("e"), F.col("version").alias("at"))
    sets = log.where("op = 'set'").select(tuples.pack_int(F.col("k")).alias("k"), "version", F.col("operand").alias("value"))
    return ranges.apply_clears(sets, clears).select(F.hex("k").alias("key_hex"), "version", "value")


_STATE = f"(SELECT k AS key, arg_max_null(value, version) AS value FROM {_LOG} WHERE version <= {{0}} GROUP BY k HAVING arg_max_null(value, version) IS NOT NULL)"


@query(f"""WITH b AS (SELECT * FROM {_STATE.format(4000)} WHERE NOT (key >= 20 AND key < 30)),
p AS (SELECT k AS key, arg_max_null(value, version) AS value FROM {_LOG} WHERE version > 4000 AND version <= 4100 GROUP BY k)
SELECT key, CASE WHEN p.key IS NOT NULL THEN p.value ELSE b.value END AS value FROM (SELECT key FROM b UNION SELECT key FROM p) u LEFT JOIN b USING (key) LEFT JOIN p USING (key)
WHERE CASE WHEN p.key IS NOT NULL THEN p.value ELSE b.value END IS NOT NULL""")
def ryw_overlay(spark, d):
    kv = event_kv(spark, d)
    pending = store.latest(kv.where("version > 4000"), 4100, keep_cleared=True).select("key", "value")
    cleared = spark.createDataFrame([(20, 30)], "s long, e long")
    return overlay.merged(store.kv_at(kv, 4000).select("key", "value"), pending, cleared)


@query(f"""WITH b AS {_STATE.format(4000)}, a AS {_STATE.format(6000)}
SELECT count(*) FILTER (WHERE b.key IS NULL) AS keys_added, count(*) FILTER (WHERE a.key IS NULL) AS keys_removed, count(*) FILTER (WHERE a.value <> b.value) AS keys_changed FROM b FULL JOIN a ON a.key = b.key""")
def mutation_counts(spark, d):
    kv = event_kv(spark, d)
    return overlay.mutation_counts(store.kv_at(kv, 4000), store.kv_at(kv, 6000))


# Conflicts


@query(f"WITH {_TXN} SELECT DISTINCT r.txn AS reader, w.txn AS writer FROM r JOIN w ON r.s < w.e AND w.s < r.e AND w.version > r.read_version AND w.version < r.version")
def conflict_pairs(spark, d):
    return conflicts.pairs(*transactions(spark, d), grid=16, lag=LAG)


@query(f"WITH {_TXN} SELECT r.txn AS reader, w.txn AS writer FROM (SELECT txn, version, read_version, s FROM r) r JOIN w ON w.e = w.s + 1 AND w.s = r.s AND w.version > r.read_version AND w.version < r.version")
def conflict_points(spark, d):
    reads, writes = transactions(spark, d)
    return conflicts.point_pairs(reads.withColumn("e", F.col("s") + 1), writes)


@query(f"WITH {_TXN} SELECT DISTINCT r.txn AS reader, w.txn AS writer FROM r JOIN w ON r.s < w.e AND w.s < r.e AND w.version > r.read_version AND w.version < r.version")
def conflict_pairs_binary(spark, d):
    """conflict_pairs over packed keys."""
    packed = lambda df: df.withColumn("s", tuples.pack_int(F.col("s"))).withColumn("e", tuples.pack_int(F.col("e")))
    reads, writes = transactions(spark, d)
    return conflicts.pairs(packed(reads), packed(writes), lag=LAG)


@query(f"""WITH RECURSIVE {_TXN}, p AS MATERIALIZED (SELECT DISTINCT r.txn AS reader, w.txn AS writer FROM r JOIN w ON r.s < w.e AND w.s < r.e AND w.version > r.read_version AND w.version < r.version),
o AS MATERIALIZED (SELECT reader, list(writer) AS writers, row_number() OVER (ORDER BY reader) AS i FROM p GROUP BY reader),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS refused
UNION ALL SELECT o.i, CASE WHEN len(list_filter(o.writers, lambda x: NOT list_contains(refused, x))) > 0 THEN list_append(refused, o.reader) ELSE refused END FROM g JOIN o ON o.i = g.i + 1),
n AS (SELECT unnest(refused) AS txn FROM g WHERE i = (SELECT max(i) FROM g))
SELECT o_orderkey // 32 AS batch, o_orderkey AS txn, n.txn IS NULL AS accepted FROM orders LEFT JOIN n ON n.txn = o_orderkey""")
def conflict_resolve(spark, d):
    """Batches of 32, each against the accepted writes of its own and of earlier ones within the window."""
    reads, writes = transactions(spark, d)
    return conflicts.resolve(reads.select("txn", F.floor(F.col("txn") / 32).alias("batch")), conflicts.pairs(reads, writes, grid=16, lag=LAG)).select("batch", "txn", "accepted")


_RESOLVERS = "(VALUES " + ", ".join(f"({i}, {i * 300}, {(i + 1) * 300 if i < 4 else 10**9})" for i in range(5)) + ") m(tag, lo, hi)"


@query(f"""WITH {_TXN}, x AS (SELECT 'read' AS side, * EXCLUDE (read_version) FROM r UNION ALL SELECT 'write', * FROM w)
SELECT x.side, x.txn, m.tag, greatest(x.s, lo) AS s, least(x.e, hi) AS e FROM x JOIN {_RESOLVERS} ON x.s < hi AND lo < x.e""")
def conflict_sharded(spark, d):
    """Read and write ranges cut at the same resolver bounds."""
    reads, writes = transactions(spark, d)
    both = reads.select(F.lit("read").alias("side"), "txn", "s", "e").unionByName(writes.select(F.lit("write").alias("side"), "txn", "s", "e"))
    shards = spark.createDataFrame([(i, i * 300, (i + 1) * 300 if i < 4 else 10**9) for i in range(5)], "tag int, start long, end long")
    return conflicts.sharded(both, shards).select("side", "txn", "tag", "s", "e")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id < 6000 THEN event_id - 1 ELSE event_id - 2 END AS last_version FROM events)
SELECT event_id AS version, last_version, CASE WHEN last_version < 1000 THEN 'stale' WHEN event_id < 6000 THEN 'ready' ELSE 'parked' END AS state FROM e""")
def conflict_sequence(spark, d):
    """What a resolver at version 1000 does with batches whose chain breaks at 6000."""
    e = table(spark, d, "events").select(F.col("event_id").alias("version"), F.when(F.col("event_id") < 6000, F.col("event_id") - 1).otherwise(F.col("event_id") - 2).alias("last_version"))
    return conflicts.in_sequence(e, 1000).select("version", "last_version", "state")


@query(f"""WITH {_TXN} SELECT count(DISTINCT version) AS versions, count(*) FILTER (WHERE e = s + 1) AS points, count(*) FILTER (WHERE e > s + 1) AS ranges, (SELECT count(*) FROM r) AS reads FROM w""")
def conflict_metrics(spark, d):
    return conflicts.metrics(*transactions(spark, d))


@query(f"WITH {_TXN} SELECT txn, s, e FROM w WHERE version >= (SELECT max(o_orderkey) FROM orders) - 500")
def conflict_retained(spark, d):
    _, writes = transactions(spark, d)
    last = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return conflicts.retained(writes, last or 0, 500).select("txn", "s", "e")


# Shards


@query(f"SELECT o_orderkey, {_TAG} AS tag FROM orders")
def shard_lookup(spark, d):
    return routing.lookup(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", ORDER_SHARDS)


@query(f"SELECT {_ORDER_KEY} AS key_hex, {_TAG} AS tag FROM orders")
def shard_lookup_binary(spark, d):
    """shard_lookup by packed keys and packed ends, from a shard map that is a table."""
    ends = spark.createDataFrame([(t, bytearray(tuples.pack(e))) for t, e in ORDER_SHARDS], "tag int, end binary")
    keys_ = orders_kv(spark, d).select("key")
    return routing.lookup_in(keys_, "key", routing.with_starts(ends, F.lit(bytearray(b"")))).select(F.hex("key").alias("key_hex"), "tag")


def _shard_map(spark) -> DataFrame:
    return routing.with_starts(spark.createDataFrame(ORDER_SHARDS, "tag int, end long"), 0)


_SHARDS = "(VALUES " + ", ".join(f"({t}, {0 if i == 0 else ORDER_SHARDS[i - 1][1]}, {e})" for i, (t, e) in enumerate(ORDER_SHARDS)) + ") m(tag, lo, hi)"


@query(f"SELECT o_orderkey, tag, greatest(o_orderkey, lo) AS s, least(o_orderkey + 3000, hi) AS e FROM orders JOIN {_SHARDS} ON o_orderkey < hi AND lo < o_orderkey + 3000")
def shard_clamp(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + 3000).alias("e"))
    return routing.clamp(o, _shard_map(spark)).select("o_orderkey", "tag", "s", "e")


@query("""WITH c AS (SELECT event_id // 100 AS version, user_id % 8 AS tag, count(*) AS n FROM events GROUP BY 1, 2)
SELECT version, CAST(tag AS INTEGER) AS tag, n, CAST(coalesce(sum(n) OVER (PARTITION BY version ORDER BY tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM c""")
def shard_slice_counts(spark, d):
    return routing.slice_index(event_log(spark, d).withColumn("version", F.floor(F.col("version") / 100)))


@query("SELECT event_id // 100 AS version, string_agg(DISTINCT CAST(user_id % 8 AS VARCHAR), ',' ORDER BY CAST(user_id % 8 AS VARCHAR)) AS tags FROM events GROUP BY 1")
def shards_touched(spark, d):
    t = routing.touched(event_log(spark, d).withColumn("version", F.floor(F.col("version") / 100)))
    return t.select("version", F.array_join(F.col("tags").cast("array<string>"), ",").alias("tags"))


_STEP = "(CAST(11400714819323198485 AS HUGEINT) % 5)"
_FREE = "CASE WHEN NOT list_contains(got, {0} % 5) THEN {0} % 5 WHEN NOT list_contains(got, ({0} + 1) % 5) THEN ({0} + 1) % 5 WHEN NOT list_contains(got, ({0} + 2) % 5) THEN ({0} + 2) % 5 ELSE ({0} + 3) % 5 END"


@query(f"""WITH RECURSIVE p AS (SELECT n_nationkey AS tag, 0 AS i, CAST(n_nationkey % 5 AS HUGEINT) AS pos, CAST([] AS HUGEINT[]) AS got FROM nation
UNION ALL SELECT tag, i + 1, ({_FREE.format('pos')} + {_STEP}) % 5, list_prepend({_FREE.format('pos')}, got) FROM p WHERE i < 3)
SELECT tag, array_to_string(got, ',') AS logs FROM p WHERE i = 3""")
def log_replicas(spark, d):
    t = routing.replicas(table(spark, d, "nation").select(F.col("n_nationkey").alias("tag")), 5, 3)
    return t.select("tag", F.array_join(F.col("logs").cast("array<string>"), ",").alias("logs"))


@query(f"SELECT o_orderkey, {_TAG} AS tag FROM orders WHERE o_orderkey >= 3000 AND o_orderkey < 9000")
def shard_pruned_scan(spark, d):
    o = routing.lookup(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", ORDER_SHARDS).withColumn("k", F.col("o_orderkey"))
    return routing.pruned(o, 3000, 9000, ORDER_SHARDS).select("o_orderkey", "tag")


# Logs, chunks, snapshots


def transaction_log(spark, d) -> DataFrame:
    """The events as transactions of up to ten mutations: version = event_id div 10, seq = event_id mod 10."""
    return event_log(spark, d).withColumn("seq", (F.col("version") % 10).cast("int")).withColumn("version", F.floor(F.col("version") / 10))


_TXLOG = f"(SELECT version // 10 AS version, CAST(version % 10 AS INTEGER) AS seq, k, value, tag FROM {_LOG})"


@query(f"SELECT version, seq, k, value FROM {_TXLOG} WHERE version IN (SELECT DISTINCT version FROM {_TXLOG} WHERE version > 300 AND version <= 900 ORDER BY version LIMIT 25)")
def log_pull(spark, d):
    """25 whole transactions."""
    return logs.pull(transaction_log(spark, d), 300, 25, 900).select("version", "seq", "k", F.col("operand").alias("value"))


def _pushes(spark, d) -> DataFrame:
    """Every event pushed twice, each expecting the one before; the one of the largest value is too large."""
    e = table(spark, d, "events")
    top = e.agg(F.max("value").alias("top"))
    size = F.when(F.col("value") == F.col("top"), logs.MAX_TRANSACTION + 1).otherwise(F.length("props"))
    e = e.withColumn("top", top.scalar()).select((F.col("event_id") - 1).alias("expected"), F.col("event_id").alias("version"), size.cast("long").alias("bytes"))
    return e.withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2))))


@query("""WITH m AS (SELECT min(event_id) AS big FROM events WHERE value = (SELECT max(value) FROM events) AND event_id > 99)
SELECT event_id AS version, arrival, CASE WHEN value = (SELECT max(value) FROM events) THEN 'tx_too_large' WHEN event_id - 1 < 99 OR arrival = 2 THEN 'tx_out_of_order'
WHEN event_id < coalesce(big, 1000000000) THEN 'accepted' ELSE 'waiting' END AS state FROM events, m, (VALUES (1), (2)) a(arrival)""")
def log_push(spark, d):
    """What a log at version 99 does with pushes that repeat, are old, too large, or follow a gap."""
    return logs.decided(_pushes(spark, d), 99).select("version", "arrival", "state")


@query(f"SELECT version, seq, k, value FROM {_TXLOG}")
def log_in_order(spark, d):
    """A log whose even versions were pushed again, with other mutations, which are refused."""
    log = transaction_log(spark, d).withColumn("push", F.lit(1))
    again = log.where("version % 2 = 0").withColumn("push", F.lit(2)).withColumn("k", F.col("k") + 1000)
    return logs.in_order(log.unionByName(again), "push").select("version", "seq", "k", F.col("operand").alias("value"))


@query(f"""SELECT version, k, value FROM {_TXLOG} WHERE tag = 3 AND version IN (SELECT DISTINCT version FROM {_TXLOG} WHERE tag = 3 AND version >= 500 AND version < 900 ORDER BY version LIMIT 40)""")
def shard_pull(spark, d):
    """A shard's transactions from storage, as the buffer holds none from version 500 on."""
    log = transaction_log(spark, d)
    return logs.shard_pull(log.where("version < 500"), log.where("version < 900"), 3, 500, 40).select("version", "k", F.col("operand").alias("value"))


_GREEDY = """o AS MATERIALIZED (SELECT {by} AS tag, {at} AS pos, {size} AS size, row_number() OVER (PARTITION BY {by} ORDER BY {at}) AS i FROM {rows}),
f AS (SELECT tag, i, pos, size, pos AS head, CAST(1 AS BIGINT) AS n, CAST(size AS BIGINT) AS total, CAST(0 AS BIGINT) AS batch FROM o WHERE i = 1
UNION ALL SELECT tag, i, pos, size, CASE WHEN full_ THEN pos ELSE head END, CASE WHEN full_ THEN 1 ELSE n + 1 END, CASE WHEN full_ THEN size ELSE total + size END, batch + CASE WHEN full_ THEN 1 ELSE 0 END
FROM (SELECT o.tag, o.i, o.pos, o.size, f.head, f.n, f.total, f.batch, {full} AS full_ FROM f JOIN o ON o.tag = f.tag AND o.i = f.i + 1))"""


@query("WITH RECURSIVE " + _GREEDY.format(by="user_id % 8", at="event_id", size="length(props)", rows="events", full="f.total >= 2000 OR o.pos - f.pos >= 60")
       + " SELECT CAST(tag AS INTEGER) AS tag, batch AS chunk, min(pos) AS min_version, max(pos) AS max_version, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2")
def chunk_plan(spark, d):
    """Chunks that a writer flushes at 2,000 bytes, or where versions lie 60 or more apart."""
    from .plans.batching import chunk_plan as plan

    log = table(spark, d, "events").select((F.col("user_id") % 8).cast("int").alias("tag"), F.col("event_id").alias("version"), F.length("props").cast("long").alias("size"))
    return plan(log, 2000, 60)


@query("WITH RECURSIVE " + _GREEDY.format(by="user_id % 4", at="event_id", size="1", rows="events", full="f.n >= 32 OR o.pos - f.head >= 100") + " SELECT CAST(tag AS INTEGER) AS proxy, pos AS txn, batch FROM f")
def commit_batches(spark, d):
    """The batches of four proxies: 32 transactions, or 100 versions since a batch's first."""
    from .plans.batching import batches

    rows = table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("proxy"), F.col("event_id").alias("txn"))
    return batches(rows, "proxy", "txn", most=32, span=100)


@query("""WITH t AS (SELECT event_id, user_id % 4 AS proxy, event_id // 50 * 9 AS pos FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY proxy ORDER BY event_id) AS i FROM t),
v AS (SELECT *, max(pos - i) OVER (PARTITION BY proxy ORDER BY event_id ROWS UNBOUNDED PRECEDING) + i AS version FROM n)
SELECT event_id, CAST(version AS BIGINT) AS version, CAST(coalesce(lag(version) OVER (PARTITION BY proxy ORDER BY event_id), 0) AS BIGINT) AS last_version FROM v""")
def commit_versions(spark, d):
    """Versions of commits that come in bursts: those of one moment take the next versions, and push later ones on."""
    from .plans.transactions import commit_versions as versions

    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("proxy"), (F.floor(F.col("event_id") / 50) * 9).alias("at"))
    return versions(rows, "at", ["event_id"], "proxy").select("event_id", "version", "last_version")


@query(f"SELECT CAST(tag AS INTEGER) AS tag, version // 1000 AS chunk, min(version) AS min_version, max(version) AS max_version, count(*) AS n FROM {_LOG} GROUP BY 1, 2")
def chunk_directory(spark, d):
    return logs.chunks(event_log(spark, d), 1000)


@query(f"SELECT CAST(tag AS INTEGER) AS tag, version // 1000 AS chunk, min(version) AS min_version, max(version) AS max_version, count(*) AS n FROM {_LOG} GROUP BY 1, 2 HAVING min(version) <= 4321 AND max(version) >= 4321")
def chunk_seek(spark, d):
    return logs.chunk_for(logs.chunks(event_log(spark, d), 1000), 4321)


@query(f"SELECT CAST(tag AS INTEGER) AS tag, min(version) AS version FROM {_LOG} WHERE version >= 7777 GROUP BY 1")
def chunk_first_at_or_after(spark, d):
    return logs.first_at_or_after(event_log(spark, d), 7777)


@query(f"SELECT min(v) AS version FROM (SELECT max(version) AS v FROM {_LOG} GROUP BY tag)")
def durable_watermark(spark, d):
    return logs.durable(event_log(spark, d))


@query(f"SELECT version, k FROM {_LOG} WHERE version > 9000")
def log_trimmed(spark, d):
    return logs.trimmed(event_log(spark, d), 9000).select("version", "k")


_BYTES = "list_transform(range(1, len({0}) + 1), lambda i: ascii(substr({0}, i, 1)))"


@query(f"""WITH m AS (SELECT version, seq, CAST(k AS VARCHAR) AS k, value FROM {_TXLOG}),
b AS (SELECT version, flatten(list(list_concat([CASE WHEN value IS NULL THEN 1 ELSE 0 END, len(k) // 256, len(k) % 256], {_BYTES.format('k')},
CASE WHEN value IS NULL THEN [] ELSE list_concat([0, 0, len(value) // 256, len(value) % 256], {_BYTES.format('value')}) END) ORDER BY seq)) AS body FROM m GROUP BY version),
s AS (SELECT version, list_transform(list_concat([1, len(body) // 65536, len(body) // 256 % 256, len(body) % 256], body), lambda x: CAST(x AS BIGINT)) AS bytes FROM b)
SELECT version, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295::BIGINT) AS crc FROM s""")
def log_checksums(spark, d):
    """CRC-32 over tag, size and mutations of each transaction."""
    return logs.checksums(transaction_log(spark, d))


@query(f"SELECT key, value FROM {_STATE.format(10**12)}")
def snapshot_compaction(spark, d):
    from .sources.snapshots import compacted

    kv = event_kv(spark, d)
    return compacted(store.kv_at(kv, 3000).select("key", "value"), kv.where("version > 3000"))


@query(f"SELECT key, value FROM {_STATE.format(5000)}")
def snapshot_latest(spark, d):
    from .sources.snapshots import Snapshots

    kv = event_kv(spark, d)
    shots = Snapshots(spark, new_folder(spark))
    for v in (1000, 5000):
        shots.write(v, store.kv_at(kv, v).select("key", "value"))
    return shots.read_latest()


# Scalars


@query("SELECT event_id, event_id + 7 AS later, CAST(sign(event_id - 5000) AS INTEGER) AS side, lpad(hex(event_id), 16, '0') AS bytes_hex FROM events")
def version_arithmetic(spark, d):
    v = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", keys.version_add(v, F.lit(7)).alias("later"), keys.compare_versions(v, F.lit(5000).cast("long")).alias("side"), F.hex(keys.version_bytes(v)).alias("bytes_hex")
    )


_BASE36 = "list_reduce([" + ", ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((x // {36**i}) % 36 AS INTEGER) + 1, 1)" for i in range(12, -1, -1)) + "], lambda a, b: a || b)"


@query(f"""WITH t AS (SELECT event_id, user_id, 18446744073709551615::HUGEINT - event_id AS x FROM events), k AS (SELECT *, {_BASE36} AS key FROM t)
SELECT event_id, key, 'c/' || CASE WHEN user_id >= 36 THEN CASE WHEN user_id >= 1296 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', user_id // 1296 + 1, 1) ELSE '' END || substr('0123456789abcdefghijklmnopqrstuvwxyz', user_id // 36 % 36 + 1, 1) ELSE '' END
|| substr('0123456789abcdefghijklmnopqrstuvwxyz', user_id % 36 + 1, 1) || '/' || key AS path, event_id AS back FROM k""")
def inverted_version_key(spark, d):
    e = table(spark, d, "events").select("event_id", keys.inverted_key(F.col("event_id")).alias("key"), keys.chunk_path(F.col("user_id"), F.col("event_id")).alias("path"))
    return e.withColumn("back", keys.version_of_inverted(F.col("key")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 255 THEN 64 WHEN o_orderkey < 65535 THEN 1024 ELSE 8192 END AS size, printf('%02X', (length(hex(o_orderkey)) + 1) // 2) || CASE WHEN length(hex(o_orderkey)) % 2 = 1 THEN '0' ELSE '' END || hex(o_orderkey) AS packed FROM orders")
def allocator_ids(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", keys.window_size(F.col("o_orderkey")).alias("size"), F.hex(keys.candidate_bytes(F.col("o_orderkey"))).alias("packed"))


@query("""WITH w AS (SELECT CASE WHEN o_orderkey < 256 THEN o_orderkey // 64 * 64 WHEN o_orderkey < 65792 THEN 256 + (o_orderkey - 256) // 1024 * 1024 ELSE 65792 + (o_orderkey - 65792) // 8192 * 8192 END AS start, count(*) AS n FROM orders GROUP BY 1)
SELECT max(start) AS latest_window_start, count(*) AS total_counters, CAST(sum(n) AS BIGINT) AS estimated_allocated FROM w""")
def allocator_stats(spark, d):
    return allocator.stats(allocator.windows(table(spark, d, "orders"), "o_orderkey"))


@query("""SELECT c_custkey AS n, CAST(w AS BIGINT) AS window, CAST(w + (7 * i + 3 * (w // size) + 3) % size AS BIGINT) AS candidate FROM (SELECT c_custkey,
CASE WHEN c_custkey < 124 THEN c_custkey // 31 * 64 ELSE 256 + (c_custkey - 124) // 511 * 1024 END AS w,
CASE WHEN c_custkey < 124 THEN c_custkey % 31 ELSE (c_custkey - 124) % 511 END AS i, CASE WHEN c_custkey < 124 THEN 64 ELSE 1024 END AS size FROM customer)""")
def allocator_allocate(spark, d):
    """An id for every customer, from windows that fill by half."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("n"))
    return allocator.allocated(c, "n", seed=3).select("n", "window", "candidate")


# Directories


def _directories(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    path = F.array("p_type", "p_brand", F.col("p_partkey").cast("string"))
    return p.select(path.alias("path"), tuples.pack_int(F.col("p_partkey")).alias("prefix"), F.lit(None).cast("string").alias("layer"))


@query("SELECT DISTINCT p_brand AS name FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def directory_list(spark, d):
    top = table(spark, d, "part").agg(F.min("p_type")).first()[0]
    return directory.children(_directories(spark, d), [top])


@query("SELECT CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN 'archive' ELSE p_type END || '/' || p_brand || '/' || p_partkey AS path FROM part")
def directory_move(spark, d):
    top = table(spark, d, "part").agg(F.min("p_type")).first()[0]
    return directory.moved(_directories(spark, d), [top], ["archive"]).select(F.array_join("path", "/").alias("path"))


@query("SELECT p_type || '/' || p_brand || '/' || p_partkey AS path FROM part WHERE p_type <> (SELECT min(p_type) FROM part)")
def directory_remove(spark, d):
    top = table(spark, d, "part").agg(F.min("p_type")).first()[0]
    return directory.removed(_directories(spark, d), [top]).select(F.array_join("path", "/").alias("path"))


# Tools


@query("WITH p AS (SELECT o_orderkey // 256 AS page, count(*) AS n FROM orders GROUP BY 1) SELECT n // 16 * 16 AS bucket, count(*) AS pages FROM p GROUP BY 1")
def analyze_histogram(spark, d):
    return tools.histogram(table(spark, d, "orders").withColumn("page", F.floor(F.col("o_orderkey") / 256)), "page", 16)


@query("WITH p AS (SELECT o_custkey AS page, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS pages, CAST(sum(n) AS BIGINT) AS keys, min(n) AS least, avg(n) AS mean, median(n) AS median, max(n) AS most FROM p")
def analyze_pages(spark, d):
    return tools.page_statistics(table(spark, d, "orders"), "o_custkey")


@query(f"SELECT {_ORDER_KEY} AS key, hex(o_orderstatus) AS value FROM orders WHERE o_orderkey >= 512 AND o_orderkey < 768")
def dump_filtered(spark, d):
    return tools.dump(orders_kv(spark, d), prefix=b"\x16\x02")


@query("""SELECT event_id, event_id - 5000 AS distance, event_id + 1 AS first_after, event_id + 3 AS third_after,
'<0,0,0,0,0,0,' || event_id // 256 || ',' || event_id % 256 || '>' AS shown, true AS valid FROM events""")
def version_functions(spark, d):
    e, v = table(spark, d, "events"), F.col("event_id")
    after = keys.version_sequence(v, F.lit(3))
    return e.select(
        "event_id", keys.version_distance(v, F.lit(5000)).cast("long").alias("distance"), after[0].alias("first_after"), after[2].alias("third_after"),
        keys.version_string(v).alias("shown"), keys.version_valid(keys.version_bytes(v)).alias("valid"),
    )


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'layout_log' WHEN 1 THEN 'shard_key' WHEN 2 THEN 'shard' WHEN 3 THEN 'materializer_key' WHEN 4 THEN 'unknown' ELSE 'error' END AS kind,
CASE WHEN n_nationkey % 6 < 4 THEN n_name END AS parameter, n_nationkey % 6 < 5 AS system FROM nation""")
def system_keys(spark, d):
    starts = [keys.SYSTEM + k.encode() for k in keys.SYSTEM_KINDS.values()] + [keys.SYSTEM + b"/else/", b"user/"]
    n = table(spark, d, "nation")
    start = F.element_at(F.array(*[F.lit(bytearray(x)) for x in starts]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    n = n.select("n_nationkey", F.concat(start, F.col("n_name").cast("binary")).alias("key"))
    kind, rest = keys.system_kind(F.col("key"))
    return n.select("n_nationkey", kind.alias("kind"), rest.cast("string").alias("parameter"), keys.is_system_key(F.col("key")).alias("system"))


@query(f"SELECT min(v) AS progress FROM (SELECT max(version) AS v FROM {_LOG} GROUP BY tag)")
def metadata_progress(spark, d):
    """Up to where every proxy has seen the metadata, so that older entries can go."""
    return logs.durable(event_log(spark, d)).withColumnRenamed("version", "progress")


@query("SELECT count(*) AS keys, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders")
def key_statistics(spark, d):
    return tools.key_statistics(table(spark, d, "orders"), "o_orderkey")


# Streams


@query(f"SELECT k, max(version) AS version, arg_max_null(value, version) AS value FROM {_LOG} GROUP BY k")
def stream_materialise(spark, d):
    from .streaming.materialise import materialise

    base = new_folder(spark)
    log = event_log(spark, d).select("k", "version", F.col("operand").alias("value"))
    log.repartitionByRange(4, "version").write.parquet(f"{base}/log")
    return materialise(spark, f"{base}/log", log.schema, f"{base}/state", f"{base}/checkpoint")


@query(f"""WITH RECURSIVE o AS (SELECT tag, version, row_number() OVER (PARTITION BY tag ORDER BY version) AS i FROM {_LOG}),
f AS (SELECT tag, i, version AS first, version, CAST(1 AS BIGINT) AS n, false AS done FROM o WHERE i = 1
UNION ALL SELECT o.tag, o.i, CASE WHEN f.done THEN o.version ELSE f.first END, o.version, CASE WHEN f.done THEN 1 ELSE f.n + 1 END, o.version - CASE WHEN f.done THEN o.version ELSE f.first END >= 500 FROM f JOIN o ON o.tag = f.tag AND o.i = f.i + 1)
SELECT CAST(tag AS BIGINT) AS tag, first, version AS last, n FROM f WHERE done""")
def stream_shard_flush(spark, d):
    from .streaming.materialise import buffered

    base = new_folder(spark)
    log = event_log(spark, d).select(F.col("tag").cast("long").alias("tag"), "version")
    log.repartitionByRange(4, "version").write.parquet(f"{base}/log")
    flushes = buffered(spark.readStream.schema(log.schema).parquet(f"{base}/log"), 500)
    q = flushes.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("tag long, first long, last long, n long").parquet(f"{base}/out")
