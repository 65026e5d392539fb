"""Steps that turn downloaded text into lines of addresses: each takes and returns ``key, line``."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions import addresses as ip

# Patterns of addresses in text. The characters around an address are part of the match,
# so of two addresses with one character between them only the first is found.
IPV4 = ip.QUAD
BLOCK = rf"{IPV4}(?:/(?:3[0-2]|[12]?[0-9]))?"
BOUND_IPV4 = rf"(?:^|[^0-9.])({IPV4})(?:\z|[^0-9.])"
BOUND_BLOCK = rf"(?:^|[^0-9./])({BLOCK})(?:\z|[^0-9./])"
TAGGED_IPV4 = rf">\s*({IPV4})\s*<"
TAGGED_BLOCK = rf">({BLOCK})<"
CHECKED_LINK = r"<a[^>]*?/ipcheck\.htm\?ip=[^>]*>([^<]+)</a>"
RISK_SAMPLE = rf"high-risk-ip-sample/({IPV4})"
RANGE = rf"^{IPV4}-{IPV4}$"
# End of fixed values.

Step = Callable[[DataFrame], DataFrame]


def _mapped(column) -> Step:
    return lambda df: df.withColumn("line", column(F.col("line"))).where("line is not null and line <> ''")


def split_lines(df: DataFrame) -> DataFrame:
    return df.select("key", F.explode(F.split("line", r"\r?\n")).alias("line"))


def remove_comments(mark: str = "#") -> Step:
    return _mapped(lambda line: F.trim(F.regexp_replace(line, rf"[{mark}].*$", "")))


def trim() -> Step:
    return _mapped(F.trim)


def grep(pattern: str, inverted: bool = False, literal: bool = False, case_insensitive: bool = False) -> Step:
    """Lines that a pattern matches; a literal one stands for itself."""
    pattern = ("(?i)" if case_insensitive else "") + (re.escape(pattern) if literal else pattern)
    return lambda df: df.where("line <> ''").where(~F.col("line").rlike(pattern) if inverted else F.col("line").rlike(pattern))


def extract(pattern: str, group: int = 0) -> Step:
    return lambda df: df.select("key", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(group))).alias("line"))


def matches(pattern: str) -> Step:
    """What a pattern's first group matches, or all of it without one, anywhere in a line, without outer white space."""
    pattern = pattern.strip()
    return lambda df: trim()(extract(pattern, min(re.compile(pattern).groups, 1))(df))


def found(pattern: str) -> Step:
    """What the first group of a pattern matches, anywhere in a line, without outer white space."""
    return lambda df: trim()(extract(pattern, 1)(df))


def cut(delimiter: str = " ", field: int = 1) -> Step:
    return _mapped(lambda line: F.trim(F.split_part(line, F.lit(delimiter), F.lit(field))))


def csv(index: int = 1, least: int | None = None, change: Callable[[Column], Column] | None = None) -> Step:
    """A column of comma-separated lines with quotes, counted from 1; lines with fewer columns are dropped."""
    least = least or index
    names = [f"c{i}" for i in range(max(index, least))]

    def run(df: DataFrame) -> DataFrame:
        row = F.from_csv("line", ", ".join(f"{n} string" for n in names), {"escape": '"'})
        value = F.trim(row[names[index - 1]])
        kept = df.select("key", F.when(row[names[least - 1]].isNotNull(), change(value) if change else value).alias("line"))
        return kept.where("line <> ''")

    return run


def csv_range() -> Step:
    """``first-last`` of the first two columns."""
    row = F.from_csv("line", "a string, b string", {"escape": '"'})
    return lambda df: df.select("key", F.trim(row["a"]).alias("a"), F.trim(row["b"]).alias("b")).where("a <> '' and b <> ''").select("key", F.concat_ws("-", "a", "b").alias("line"))


def numeric_range() -> Step:
    """``first-last`` in dotted form of the first two columns, which hold numbers; one address alone."""
    def run(df: DataFrame) -> DataFrame:
        row = F.from_csv("line", "a string, b string", {"escape": '"'})
        ends = df.select("key", F.trim(row["a"]).try_cast("bigint").alias("a"), F.trim(row["b"]).try_cast("bigint").alias("b")).where("a between 0 and 4294967295 and b between 0 and 4294967295")
        quad = lambda c: F.concat_ws(".", *(F.shiftright(c, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)))
        return ends.select("key", F.when(F.col("a") == F.col("b"), quad("a")).otherwise(F.concat_ws("-", quad("a"), quad("b"))).alias("line"))

    return run


def json_path(path: str) -> Step:
    """The values at a path of JSON lines; ``[*]`` stands for every element, and text values have no quotes."""
    if "*" not in path:
        return _mapped(lambda line: F.get_json_object(line, path))

    def run(df: DataFrame) -> DataFrame:
        head, _, tail = path.partition("[*]")
        items = F.from_json(F.get_json_object("line", head if head.startswith("$") else f"$.{head}"), "array<string>")
        each = df.select("key", F.explode(items).alias("line"))
        rest = tail.lstrip(".")
        return each.where("line <> ''") if not rest else json_path(f"$.{rest}")(each)

    return run


def json_paths(paths: str) -> Step:
    """The values at several paths, separated by commas."""
    steps = [json_path(p.strip()) for p in re.split(r"[,\n\r\t]", paths) if p.strip()]
    return lambda df: reduce(DataFrame.unionByName, [step(df) for step in steps])


def xml_tag(tag: str = "ip", change: Callable[[Column], Column] | None = None) -> Step:
    """What stands between the tags of a name, in whatever case, without outer white space."""
    def run(df: DataFrame) -> DataFrame:
        inside = df.select("key", F.explode(F.regexp_extract_all("line", F.lit(rf"(?is)<{re.escape(tag)}[^>]*>(.*?)</{re.escape(tag)}>"), F.lit(1))).alias("line"))
        plain = F.col("line")
        for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(mark), F.lit(char))
        text = F.btrim(plain, F.lit(" \t\r\n"))
        return inside.select("key", text.alias("line")).where("line <> ''").select("key", (change(F.col("line")) if change else F.col("line")).alias("line")).where("line <> ''")

    return run


def title_host() -> Step:
    """What stands before the last colon of titles."""
    return xml_tag("title", lambda x: F.when(F.instr(x, ":") > 1, F.trim(F.regexp_extract(x, r"(?s)^(.+):[^:]*$", 1))))


def title_ipv4() -> Step:
    """The first address before the bar of titles."""
    return xml_tag("title", lambda x: F.regexp_extract(F.split_part(x, F.lit("|"), F.lit(1)), BOUND_IPV4, 1))


def proxy_ip() -> Step:
    return xml_tag("prx:ip", lambda x: F.when(ip.is_ipv4(x) | ip.is_ipv6(x), x))


def padded_ipv4() -> Step:
    """Addresses in ``ip`` tags with the zeros in front of their parts removed."""
    number = lambda p: p.try_cast("int").cast("string")
    return xml_tag("ip", lambda x: F.when(x.rlike(r"^[+-]?[0-9]+(?:\.[+-]?[0-9]+){3}$"), F.array_join(F.transform(F.split(x, r"\."), number), ".")))


def firewall_denials() -> Step:
    """``access-list`` lines that deny a host or a network and mask."""
    def run(df: DataFrame) -> DataFrame:
        line = F.col("line")
        host = F.regexp_extract(line, r" deny ip host +(\S+)", 1)
        net = F.regexp_extract(line, r" deny ip +(\S+)\s+(\S+)", 1)
        mask = F.regexp_extract(line, r" deny ip +(\S+)\s+(\S+)", 2)
        value = F.when(line.contains(" deny ip host "), host).when(mask != "", F.concat_ws("/", net, mask))
        bare = remove_comments()(df)
        return bare.where(line.contains(" deny ip ") & (F.get(fields(line), F.lit(0)) == "access-list") & (F.size(fields(line)) >= 7)).select("key", value.alias("line")).where("line <> ''")

    return run


def labelled_ranges(only: str = "") -> Step:
    """The range after the first colon of ``label:first-last`` lines, of labels that start with a text."""
    def run(df: DataFrame) -> DataFrame:
        bare = df.select("key", F.trim("line").alias("line")).where(F.startswith("line", F.lit(only)))
        return bare.select("key", F.trim(F.get(F.split("line", ":", -1), F.lit(1))).alias("line")).where(F.col("line").rlike(RANGE))

    return run


def first_seen(step: Step) -> Step:
    """Each line of a key once."""
    return lambda df: step(df).distinct()


def watchlist() -> Step:
    """The first column of lines that name the watch list."""
    return lambda df: _mapped(lambda line: F.btrim(F.trim(F.split_part(line, F.lit(","), F.lit(1))), F.lit('"')))(df.where("contains(line, 'IP Watchlist')"))


def crime_servers() -> Step:
    """The addresses of the elements of ``crimeServers``."""
    return lambda df: json_path("$.crimeServers[*].ip")(df).select("key", F.trim("line").alias("line")).where("line <> '' and lower(line) <> 'null'")


def unpacked_csv() -> Step:
    """Every field of comma-separated text as a line."""
    return lambda df: trim()(df.select("key", F.explode(F.split("line", r"[,\r\n]")).alias("line")))


def kept(test: Callable[[Column], Column], strip: str = "") -> Step:
    """Lines that pass a test after a suffix is stripped."""
    def run(df: DataFrame) -> DataFrame:
        line = F.trim("line")
        bare = df.select("key", (F.regexp_replace(line, f"{strip}$", "") if strip else line).alias("line"))
        return bare.where("line <> ''").where(test(F.col("line")))

    return run


def collapsed() -> Step:
    """White space as single blanks; lines of the zero address or block are dropped."""
    return lambda df: drop_invalid()(_mapped(lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))(df))


def append_slash32() -> Step:
    return append_slash(32)


def append_slash(bits: int) -> Step:
    """The first field of a line, with the prefix length where it has none."""
    def suffixed(line: Column) -> Column:
        first = F.regexp_extract(line, r"\S+", 0)
        return F.when(first.contains("/") | (first == ""), first).otherwise(F.concat(first, F.lit(f"/{bits}")))

    return _mapped(suffixed)


def remove_slash(bits: int) -> Step:
    return _mapped(lambda line: F.regexp_replace(line, f"/{bits}$", ""))


def remove_slash32() -> Step:
    return remove_slash(32)


def drop_invalid() -> Step:
    return lambda df: df.where("line <> '' and line <> '0.0.0.0' and not endswith(line, '/0')")


def fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def tor_exits() -> Step:
    """The address of ``ExitAddress`` lines."""
    return _mapped(lambda line: F.when(F.get(fields(line), F.lit(0)) == "ExitAddress", F.get(fields(line), F.lit(1))))


def start_and_bits() -> Step:
    """``start end bits ...`` lines as ``start/bits``, where the first field starts with a digit from 1 to 9."""
    def run(df: DataFrame) -> DataFrame:
        f = fields(F.col("line"))
        return remove_comments()(df).where((F.size(f) >= 3) & F.get(f, F.lit(0)).rlike("^[1-9]")).select("key", F.concat_ws("/", F.get(f, F.lit(0)), F.get(f, F.lit(2))).alias("line"))

    return run


def third_bar_field() -> Step:
    return lambda df: _mapped(lambda line: F.trim(F.regexp_replace(F.split_part(line, F.lit("|"), F.lit(3)), r"\s+", " ")))(remove_comments()(df))


def alert_rules() -> Step:
    """The addresses in the first brackets of ``alert`` rules."""
    return lambda df: trim()(df.where("startswith(line, 'alert ')").select(
        "key", F.explode(F.split(F.regexp_extract("line", r"\[([^\]]*)\]", 1), ",")).alias("line")))


def before_colon() -> Step:
    """What stands before the first colon of lines that have one."""
    return lambda df: _mapped(lambda line: F.when(line.contains(":"), F.trim(F.split_part(line, F.lit(":"), F.lit(1)))))(remove_comments()(df))


def netmask_to_bits() -> Step:
    """``address/netmask`` as ``address/length``; a line without a valid netmask stays."""
    dotted = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    bits = F.create_map(*(F.lit(x) for p in range(33) for x in (dotted((1 << 32) - (1 << 32 - p)), str(p))))

    def rewritten(line: Column) -> Column:
        found = F.try_element_at(bits, F.regexp_extract(line, r"/([0-9.]+)$", 1))
        return F.when(found.isNotNull(), F.concat(F.substring_index(line, "/", 1), F.lit("/"), found)).otherwise(line)

    return _mapped(rewritten)


# Names of the steps, with all their aliases.
STEPS: dict[str, Callable[..., Step]] = {
    "passthrough": lambda: lambda df: df, "cat": lambda: lambda df: df, "$CAT_CMD": lambda: lambda df: df,
    "split_lines": lambda: split_lines, "sanitize": collapsed, "trim": trim,
    "remove_comments": remove_comments, "remove_comments_semi": lambda: remove_comments(";"), "remove_comments_semi_colon": lambda: remove_comments(";"),
    "snort_rules": alert_rules, "snort_alert_rules_to_ipv4": alert_rules, "pix_deny_rules": firewall_denials, "pix_deny_rules_to_ipv4": firewall_denials,
    "dshield_format": start_and_bits, "dshield_parser": start_and_bits, "xml_rss_title_resolve": title_host, "parse_rss_rosinstrument": title_host,
    "xml_rss_proxy": proxy_ip, "parse_rss_proxy": proxy_ip, "xml_rss_title": title_ipv4, "parse_php_rss": title_ipv4,
    "xml_tag": xml_tag, "parse_xml_clean_mx": xml_tag, "dshield_api_xml": padded_ipv4, "parse_dshield_api": padded_ipv4,
    "subnet_to_cidr": netmask_to_bits, "subnet_to_bitmask": netmask_to_bits,
    "extract_ipv4": lambda: found(BOUND_IPV4), "extract_ipv4_from_any_file": lambda: found(BOUND_IPV4),
    "extract_ipv4_cidr": lambda: found(BOUND_BLOCK), "extract_cidr": lambda: found(BOUND_BLOCK), "extract_ipv4_cidr_from_any_file": lambda: found(BOUND_BLOCK),
    "csv_column": csv, "csv_comma_first_column": csv, "unzip_csv": unpacked_csv, "unzip_and_split_csv": unpacked_csv,
    "p2p_blocklist": labelled_ranges, "p2p_gz": labelled_ranges, "p2p_gz_ips": labelled_ranges,
    "p2p_blocklist_proxy": lambda: labelled_ranges("Proxy"), "p2p_gz_proxy": lambda: labelled_ranges("Proxy"),
    "torproject_exits": tor_exits, "dataplane_column3": third_bar_field, "parse_cleantalk": lambda: found(TAGGED_IPV4), "parse_ipblacklistcloud": lambda: found(TAGGED_IPV4),
    "parse_cta_cryptowall": lambda: csv(3), "parse_graphiclineweb": lambda: found(TAGGED_BLOCK), "botscout_filter": lambda: found(CHECKED_LINK), "gz_proxyrss": before_colon,
    "ip2location_ip2proxy_px1lite": numeric_range, "regex": matches, "grep": grep, "grep_not": lambda pattern, **kw: grep(pattern, inverted=True, **kw),
    "cut_delimiter": cut, "json_path": json_path, "json_paths": json_paths,
    "remove_slash32": remove_slash32, "append_slash32": append_slash32, "remove_slash128": lambda: remove_slash(128), "append_slash128": lambda: append_slash(128),
    "filter_ip4": lambda: kept(ip.is_ipv4, "/32"), "filter_net4": lambda: kept(lambda x: (ip.is_cidr4(x) | ip.is_cidr6(x)) & ~x.endswith("/0"), "/32"),
    "filter_all4": lambda: kept(lambda x: ip.is_ipv4(x) | ip.is_cidr4(x)), "filter_invalid4": drop_invalid,
    "filter_ip6": lambda: kept(ip.is_ipv6, "/128"), "filter_net6": lambda: kept(ip.is_cidr6, "/128"), "filter_all6": lambda: kept(lambda x: ip.is_ipv6(x) | ip.is_cidr6(x)),
    "blueliv_parser": crime_servers, "parse_cvs_clean_mx_phishing": lambda: csv(10, change=lambda x: F.replace(x, F.lit("|"), F.lit("_"))),
    "parse_client9_ipcat_datacenters": csv_range, "parse_maxmind_proxy_fraud": lambda: first_seen(found(RISK_SAMPLE)), "parse_uscert_csv": watchlist,
}
# End of fixed values.

#: Steps that need the whole body in one row, for tags that span lines; the others work on lines or bodies alike.
WHOLE = frozenset({"xml_rss_title_resolve", "parse_rss_rosinstrument", "xml_rss_proxy", "parse_rss_proxy", "xml_rss_title", "parse_php_rss", "xml_tag", "parse_xml_clean_mx",
                   "dshield_api_xml", "parse_dshield_api", "blueliv_parser", "unzip_csv", "unzip_and_split_csv"})


def needs_bodies(steps: list[tuple[str, dict]]) -> bool:
    """Whether a body must stay in one row at the start; once a step has cut it, lines are enough."""
    return bool(steps) and steps[0][0] in WHOLE


def run(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Applies named steps in order; narrow transforms, so Spark runs them in one pass."""
    return reduce(lambda d, s: STEPS[s[0]](**s[1])(d), steps, df)
