"""Queries that run text steps over the text columns of the shared tables."""

from __future__ import annotations

from rangeloom.operators import intervals as iv
from rangeloom.operators import text_steps as t
from rangeloom.plans import bindings as b
from rangeloom.sources import text


def _lines(name: str, key: str, column: str):
    return lambda s, d: b.table(s, d, name).selectExpr(f"{key} AS key", f"{column} AS line")


def register_all(register) -> None:
    def steps(name, source, *which, oracle):
        register(name, lambda s, d: t.run(source(s, d), list(which)), oracle)

    docs, props = _lines("documents", "doc_id", "text"), _lines("events", "event_id", "props")
    parts = _lines("part", "p_partkey", "concat_ws(',', p_brand, p_type, p_name)")
    steps("extract_ipv4_documents", docs, ("extract_ipv4", {}), oracle=f"SELECT doc_id AS key, unnest(regexp_extract_all(text, '{t.BOUND_IPV4}', 1)) AS line FROM documents")
    register("extract_ipv4_numbers", lambda s, d: t.run(docs(s, d), [("extract_ipv4", {})]).select("key", iv.ip_number(iv.F.col("line")).alias("ip")).where("ip is not null"),
             f"""WITH x AS (SELECT doc_id AS key, string_split(unnest(regexp_extract_all(text, '{t.BOUND_IPV4}', 1)), '.') AS p FROM documents)
             SELECT key, p[1]::bigint * 16777216 + p[2]::bigint * 65536 + p[3]::bigint * 256 + p[4]::bigint AS ip FROM x""")
    steps("json_path_events", props, ("json_path", {"path": "$.k"}), ("append_slash32", {}), oracle="SELECT event_id AS key, json_extract_string(props, '$.k') || '/32' AS line FROM events WHERE json_extract_string(props, '$.k') <> ''")
    steps("grep_events", props, ("grep", {"pattern": "[13579][}]$"}), ("grep_not", {"pattern": "77"}), oracle="SELECT event_id AS key, props AS line FROM events WHERE regexp_matches(props, '[13579][}]$') AND NOT regexp_matches(props, '77')")
    steps("csv_cut_parts", parts, ("cut_delimiter", {"delimiter": ",", "field": 2}), ("trim", {}), oracle="SELECT p_partkey AS key, trim(split_part(concat_ws(',', p_brand, p_type, p_name), ',', 2)) AS line FROM part WHERE trim(split_part(concat_ws(',', p_brand, p_type, p_name), ',', 2)) <> ''")
    steps("comment_lines_documents", docs, ("split_lines", {}), ("remove_comments", {}), ("filter_invalid4", {}),
          oracle=r"""SELECT * FROM (SELECT doc_id AS key, trim(regexp_replace(unnest(regexp_split_to_array(text, '\r?\n')), '[#].*$', '')) AS line FROM documents) q
          WHERE line <> '' AND line <> '0.0.0.0' AND NOT ends_with(line, '/0')""")
    steps("extract_cidr_documents", docs, ("extract_ipv4_cidr", {}), oracle=f"SELECT doc_id AS key, unnest(regexp_extract_all(text, '{t.BOUND_BLOCK}', 1)) AS line FROM documents")
    steps("page_titles", _lines("pages", "page_id", "html"), ("xml_tag", {"tag": "title"}), oracle=r"""SELECT * FROM (SELECT page_id AS key, trim(replace(replace(replace(replace(replace(unnest(regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1)),
          '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), E' \t\r\n') AS line FROM pages) q WHERE line <> ''""")
    one = "SELECT event_id AS key, json_extract_string(props, '$.k') AS line FROM events WHERE json_extract_string(props, '$.k') <> ''"
    steps("json_paths_events", props, ("json_paths", {"paths": "$.k, $.none,$.k"}), oracle=f"{one} UNION ALL {one}")

    def made(sql):
        return lambda s, d: b.bound(s, d, sql, "orders")

    base = f"SELECT CAST(o_orderkey AS bigint) AS key, CAST(o_orderkey AS bigint) AS k, {b.IP} AS ip FROM orders"
    quad = b.quad("ip")
    steps("start_and_length_lines", made(f"SELECT key, CASE k % 4 WHEN 0 THEN concat('x y ', CAST(k % 33 AS string)) WHEN 1 THEN '# note' ELSE concat({quad}, ' ', {quad}, ' ', CAST(k % 33 AS string), ' tail') END AS line FROM ({base}) q"),
          ("dshield_format", {}), oracle=f"SELECT key, {quad} || '/' || CAST(k % 33 AS varchar) AS line FROM ({base}) q WHERE k % 4 > 1 AND ip >= 16777216")
    steps("denied_hosts_and_networks", made(f"SELECT key, CASE k % 3 WHEN 0 THEN concat('access-list 7 deny ip host ', {quad}, ' any') WHEN 1 THEN concat('access-list 7 deny ip ', {quad}, ' 255.255.255.0 any log') ELSE concat('access-list 7 permit ip host ', {quad}, ' any') END AS line FROM ({base}) q"),
          ("pix_deny_rules", {}), oracle=f"SELECT key, {quad} || CASE k % 3 WHEN 1 THEN '/255.255.255.0' ELSE '' END AS line FROM ({base}) q WHERE k % 3 < 2")
    steps("labelled_proxy_ranges", made(f"SELECT key, concat(CASE k % 2 WHEN 0 THEN 'Proxy one' ELSE 'Other' END, ':', {quad}, '-', {quad}, CASE k % 5 WHEN 0 THEN 'x' ELSE '' END) AS line FROM ({base}) q"),
          ("p2p_blocklist_proxy", {}), oracle=f"SELECT key, {quad} || '-' || {quad} AS line FROM ({base}) q WHERE k % 2 = 0 AND k % 5 > 0")
    steps("quoted_csv_columns", made(f"SELECT key, CASE k % 3 WHEN 0 THEN 'lonely' ELSE concat('\"a, b\",', {quad}, ',z') END AS line FROM ({base}) q"), ("csv_column", {"index": 2}), oracle=f"SELECT key, {quad} AS line FROM ({base}) q WHERE k % 3 > 0")
    kinds = f"""CASE k % 8 WHEN 0 THEN {quad} WHEN 1 THEN concat({quad}, '/24') WHEN 2 THEN concat('2001:db8::', lower(hex(k % 65536))) WHEN 3 THEN concat('2001:db8::', lower(hex(k % 65536)), '/64') WHEN 4 THEN concat('::ffff:', {quad})
             WHEN 5 THEN '1:2:3:4:5:6:7:8:9' WHEN 6 THEN concat({quad}, '/33') ELSE concat('1:2:3:4:5:6:', {quad}) END"""
    for name, step, test in (("filter_all4_lines", "filter_all4", "k % 8 IN (0, 1, 4)"), ("filter_ip6_lines", "filter_ip6", "k % 8 IN (2, 7)"), ("filter_net6_lines", "filter_net6", "k % 8 = 3"), ("filter_net4_lines", "filter_net4", "k % 8 IN (1, 3)")):
        steps(name, made(f"SELECT key, {kinds} AS line FROM ({base}) q"), (step, {}), oracle=f"SELECT key, {kinds} AS line FROM ({base}) q WHERE {test}")
    register("parsed_lines", lambda s, d: text.parsed(text.lines(b.bound(s, d, b.LINES, "orders").withColumnRenamed("line", "body"))).select("key", "kind", iv.F.coalesce("lo", iv.F.lit(-1)).alias("lo"), iv.F.coalesce("hi", iv.F.lit(-1)).alias("hi")),
             f"""SELECT k AS key, CASE k % 10 WHEN 7 THEN 'rejected' WHEN 8 THEN 'reversed' WHEN 9 THEN 'hostname' ELSE 'range' END AS kind,
             CASE k % 10 WHEN 1 THEN ip - ip % (1::bigint << (32 - k % 33)) WHEN 5 THEN ip - ip % 65536 WHEN 7 THEN -1 WHEN 8 THEN ip + 1 WHEN 9 THEN -1 ELSE ip END AS lo,
             CASE k % 10 WHEN 1 THEN ip - ip % (1::bigint << (32 - k % 33)) + (1::bigint << (32 - k % 33)) - 1 WHEN 2 THEN ip + k % 1000 WHEN 5 THEN ip - ip % 65536 + 65535 WHEN 7 THEN -1 WHEN 9 THEN -1 ELSE ip END AS hi
             FROM (SELECT CAST(o_orderkey AS bigint) AS k, {b.IP} % 4294000000 AS ip FROM orders) q""")
