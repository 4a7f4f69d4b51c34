"""Versioned address sets and rule lists."""

from pyspark.sql import functions as F

from netloom.functions import net
from netloom.operators import sets
from netloom.plans.registry import query
from netloom.plans.score_queries import SQL_LIST, listed

SQL_CONTENT = """
ep AS (SELECT store, MAX(epoch) AS epoch FROM t_addr_store GROUP BY 1),
co AS (SELECT store, address FROM (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.store, s.address ORDER BY s.version DESC) AS rn
 FROM t_addr_store s JOIN ep ON ep.store = s.store AND ep.epoch = s.epoch) WHERE rn = 1 AND is_add),
wa AS (SELECT DISTINCT 'addresses' AS store, dst AS address FROM t_lan_flows WHERE dst LIKE '198.51.0.%'
 UNION SELECT store, address FROM co WHERE store = 'addresses' AND address LIKE '203.0.1.%')"""


def content(t):
    return sets.set_content(t("t_addr_store"), "addresses")


def wanted(t):
    """Some new addresses, and some that are in the set."""
    new = t("t_lan_flows").where("dst LIKE '198.51.0.%'").select(
        F.lit("addresses").alias("store"), F.col("dst").alias("address")
    )
    return new.union(content(t).where("address LIKE '203.0.1.%'")).distinct()


@query("u03_set_content", f"WITH {SQL_CONTENT.strip()} SELECT * FROM co")
def contents(t):
    return sets.set_content(t("t_addr_store"))


@query(
    "u07_set_versions",
    "SELECT store, epoch, MAX(version) AS version FROM t_addr_store s WHERE epoch = (SELECT MAX(epoch) FROM t_addr_store e WHERE e.store = s.store) GROUP BY 1, 2",
)
def versions(t):
    return sets.set_versions(t("t_addr_store"))


@query(
    "u04_set_diff",
    f"""WITH {SQL_CONTENT.strip()}
    SELECT store, 2 AS epoch, CAST(77 AS BIGINT) AS version, TRUE AS is_add, address FROM (SELECT * FROM wa EXCEPT SELECT * FROM co)
    UNION ALL SELECT store, 2, 77, FALSE, address FROM (SELECT * FROM co WHERE store = 'addresses' EXCEPT SELECT * FROM wa)""",
)
def diff(t):
    return sets.set_diff(content(t), wanted(t), F.lit(2), F.lit(77).cast("long"))


@query(
    "u05_set_diff_keep",
    f"""WITH {SQL_CONTENT.strip()},
    ke AS (SELECT remote_address FROM t_firewall_log WHERE direction = 'I' GROUP BY 1 HAVING COUNT(DISTINCT router_id) > 8 AND COUNT(*) > 40)
    SELECT store, 2 AS epoch, CAST(77 AS BIGINT) AS version, TRUE AS is_add, address FROM (SELECT * FROM wa EXCEPT SELECT * FROM co)
    UNION ALL SELECT store, 2, 77, FALSE, address FROM (SELECT * FROM co WHERE store = 'addresses' EXCEPT SELECT * FROM wa)
    WHERE address NOT IN (SELECT remote_address FROM ke)""",
)
def diff_keep(t):
    have, want = content(t), wanted(t)
    candidates = have.join(want, ["store", "address"], "left_anti")
    keep = sets.still_active(t("t_firewall_log"), candidates, 8, 40)
    return sets.set_diff(have, want, F.lit(2), F.lit(77).cast("long"), keep)


SQL_DIFF = """SELECT address, is_add FROM (SELECT address, is_add, ROW_NUMBER() OVER (PARTITION BY address ORDER BY version DESC) AS rn
 FROM t_addr_store WHERE store = 'set_a' AND epoch = 1 AND version > {since} AND version <= {until}) WHERE rn = 1"""


@query("u06_version_diff", SQL_DIFF.format(since=700, until=2500))
def version_diff(t):
    return sets.version_diff(t("t_addr_store"), "set_a", 1, 700, 2500)


@query("u06_version_diff_full", SQL_DIFF.format(since=0, until=2500) + " AND is_add")
def version_diff_full(t):
    return sets.version_diff(t("t_addr_store"), "set_a", 1, 0, 2500, full=True)


@query("u08_apply_diff", "SELECT address FROM (" + SQL_DIFF.format(since=-1, until=2500) + ") WHERE is_add")
def applied(t):
    log = t("t_addr_store")
    replica = sets.version_diff(log, "set_a", 1, -1, 700, full=True)
    return sets.apply_diff(replica, sets.version_diff(log, "set_a", 1, 700, 2500))


@query(
    "u08_update_kind",
    """WITH v AS (SELECT store, epoch, version FROM t_addr_store),
    h AS (SELECT store, MAX(epoch) AS e, MAX(version) AS m FROM t_addr_store GROUP BY 1)
    SELECT v.store, v.version, CASE WHEN v.epoch <> h.e THEN 'full' WHEN v.version = h.m - 1000 THEN 'none' WHEN v.version < h.m - 1000 THEN 'incremental' ELSE 'resync' END AS kind
    FROM v JOIN h ON v.store = h.store""",
)
def kinds(t):
    log = t("t_addr_store")
    newest = sets.set_versions(log).select("store", F.col("epoch").alias("e"), (F.col("version") - 1000).alias("m"))
    kind = sets.update_kind(F.col("epoch"), F.col("version"), F.col("e"), F.col("m"))
    return log.join(newest, "store").select("store", "version", kind.alias("kind"))


@query(
    "w06_audit_changes",
    """SELECT store, epoch, address, version, CASE WHEN is_add THEN 'repeated add' ELSE 'absent removal' END AS problem
    FROM (SELECT *, LAG(is_add, 1, FALSE) OVER (PARTITION BY store, epoch, address ORDER BY version) AS was FROM t_addr_store) WHERE is_add = was""",
)
def audit(t):
    return sets.audit_changes(t("t_addr_store"))


# Four sets of address lists with small declared sizes.
SQL_SIZED = """sc AS (SELECT DISTINCT concat('s', CAST(l_linenumber AS VARCHAR)) AS store, l_partkey % (l_linenumber * 37) AS address FROM lineitem)"""


@query(
    "u10_set_sizes",
    f"""WITH {SQL_SIZED}, n AS (SELECT store AS name, COUNT(*) AS needed FROM sc GROUP BY 1)
    SELECT name, CASE WHEN needed > 64 THEN CAST(pow(2, greatest(1, ceil(log2(needed)))) AS BIGINT) ELSE 64 END AS maxsize,
    CASE WHEN needed > 64 THEN CAST(4 * pow(2, greatest(1, ceil(log2(needed)))) AS BIGINT) ELSE 256 END AS hashsize, needed > 64 AS raised FROM n""",
)
def sizes(t):
    content_rows = t.sql(
        "SELECT DISTINCT concat('s', CAST(l_linenumber AS STRING)) AS store, l_partkey % (l_linenumber * 37) AS address FROM {lineitem}"
    )
    declared = content_rows.select(F.col("store").alias("name")).distinct().select(
        "name", F.lit(64).cast("long").alias("maxsize"), F.lit(256).cast("long").alias("hashsize")
    )
    return sets.set_sizes(declared, content_rows)


# Rules: ip with port, bare ip, or range, by line number.
SQL_RULES = """ru AS (SELECT DISTINCT concat('198.51.', CAST(l_partkey % 4 AS VARCHAR), '.', CAST(l_partkey % 200 AS VARCHAR)) AS ip,
 CASE WHEN l_linenumber IN (1, 2) THEN 20 + l_linenumber END AS port, CASE WHEN l_linenumber = 7 AND l_partkey % 3 = 0 THEN 24 END AS prefix
 FROM lineitem WHERE l_linenumber IN (1, 2, 7) AND (l_linenumber < 7 OR l_partkey % 5 = 0)),
gr AS (SELECT DISTINCT address FROM t_addr_store WHERE address LIKE '203.0.1.%'),
om AS (SELECT DISTINCT address FROM t_addr_store WHERE address LIKE '203.0.1.1%' UNION SELECT '198.51.2.102'),
""" + SQL_LIST.strip() + """,
ex AS (SELECT ip AS address, port FROM ru WHERE prefix IS NULL UNION SELECT address, NULL FROM gr UNION SELECT remote, NULL FROM listed),
ev AS (SELECT DISTINCT address FROM ex WHERE port IS NULL AND address NOT IN (SELECT address FROM om)),
fin AS (SELECT address, NULL AS port FROM ev UNION ALL
 SELECT DISTINCT address, port FROM ex WHERE port IS NOT NULL AND address NOT IN (SELECT address FROM om) AND address NOT IN (SELECT address FROM ev))"""


def wanted_lists(t):
    rules = t.sql(
        """SELECT DISTINCT concat('198.51.', CAST(l_partkey % 4 AS STRING), '.', CAST(l_partkey % 200 AS STRING)) AS ip,
        CASE WHEN l_linenumber IN (1, 2) THEN 20 + l_linenumber END AS port, CASE WHEN l_linenumber = 7 AND l_partkey % 3 = 0 THEN 24 END AS prefix
        FROM {lineitem} WHERE l_linenumber IN (1, 2, 7) AND (l_linenumber < 7 OR l_partkey % 5 = 0)"""
    )
    store = t("t_addr_store").select("address").distinct()
    grey = store.where("address LIKE '203.0.1.%'")
    omit = store.where("address LIKE '203.0.1.1%'").union(rules.where("ip = '198.51.2.102'").select("ip").distinct())
    black = listed(t).select(F.col("remote").alias("address")).distinct()
    return sets.wanted_addresses(rules, [grey, black], omit)


@query("u09_wanted_addresses", f"WITH {SQL_RULES} SELECT address, CAST(port AS INTEGER) AS port FROM fin")
def exact(t):
    return wanted_lists(t)[0]


@query("u09_wanted_ranges", f"WITH {SQL_RULES} SELECT DISTINCT ip AS address, prefix FROM ru WHERE prefix IS NOT NULL")
def ranges(t):
    return wanted_lists(t)[1]


@query("x08_addr_port", f"WITH {SQL_RULES} SELECT DISTINCT CASE WHEN port IS NULL THEN address ELSE concat(address, ':', port) END AS address FROM fin")
def flat(t):
    return sets.flattened(wanted_lists(t)[0])


@query("x10_flatten_rules", f"WITH {SQL_RULES} SELECT DISTINCT CAST(port AS INTEGER) AS port, address FROM fin")
def rules(t):
    texts = sets.flatten_rules(wanted_lists(t)[0], per_rule=50)
    return texts.select("port", F.explode(F.split("items", ",")).alias("address"))


@query("x08_parse_addr_port", f"WITH {SQL_RULES} SELECT DISTINCT address, CAST(port AS INTEGER) AS port FROM fin")
def parsed(t):
    return flat(t).select(net.parse_addr_port("address").alias("p")).select("p.*")


@query("u02_distinct", "SELECT DISTINCT store FROM t_addr_store")
def stores(t):
    return t("t_addr_store").select("store").distinct()


@query("j11_exclude", "SELECT * FROM t_firewall_log WHERE remote_address NOT IN (SELECT address FROM t_addr_store WHERE is_add)")
def excluded(t):
    from netloom.operators.joins import exclude

    return exclude(t("t_firewall_log"), t("t_addr_store").where("is_add"), "remote_address")


@query(
    "j12_cidr_join",
    """WITH pf AS (SELECT DISTINCT concat('203.0.', CAST(l_partkey % 3 AS VARCHAR), '.', CAST((l_partkey % 13) * 8 AS VARCHAR)) AS network,
     CASE WHEN l_partkey % 2 = 0 THEN 29 ELSE 28 END AS prefix FROM lineitem),
    pn AS (SELECT network, prefix, (split_part(network, '.', 3)::BIGINT * 256 + split_part(network, '.', 4)::BIGINT) >> (32 - prefix) AS k FROM pf),
    an AS (SELECT id, remote_address, split_part(remote_address, '.', 3)::BIGINT * 256 + split_part(remote_address, '.', 4)::BIGINT AS n FROM t_firewall_log)
    SELECT an.id, an.remote_address, pn.network, pn.prefix FROM an JOIN pn ON an.n >> (32 - pn.prefix) = pn.k""",
)
def cidr(t):
    return net.cidr_join(t("t_firewall_log").select("id", "remote_address"), "remote_address", prefixes(t))


def prefixes(t):
    return t.sql(
        """SELECT DISTINCT concat('203.0.', CAST(l_partkey % 3 AS STRING), '.', CAST((l_partkey % 13) * 8 AS STRING)) AS network,
        CASE WHEN l_partkey % 2 = 0 THEN 29 ELSE 28 END AS prefix FROM {lineitem}"""
    )


@query(
    "f09_drop_subnets",
    """SELECT id, remote_address FROM t_firewall_log WHERE NOT (split_part(remote_address, '.', 4)::INTEGER < 32 AND remote_address LIKE '203.0.1.%')""",
)
def outside(t):
    # One /27, derived from the addresses that start it.
    subnets = t("t_firewall_log").where("remote_address = '203.0.1.0' OR remote_address = '203.0.1.1'").select(
        F.lit("203.0.1.0").alias("network"), F.lit(27).alias("prefix")
    ).distinct()
    return net.drop_subnets(t("t_firewall_log").select("id", "remote_address"), "remote_address", subnets)
