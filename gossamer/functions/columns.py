"""Column expressions over URLs, hosts, pages and signals. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gossamer.functions import fixed as X


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))


def is_ip(h: Column, port: bool = True) -> Column:
    """Four decimal parts of 0 to 255; with ``port`` a port at the end is not part of the address."""
    parts = F.split(F.regexp_replace(h, r":\d+$", "") if port else h, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^0*(\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])$"))


def suffix(h: Column) -> Column:
    last2 = F.substring_index(h, ".", -2)
    return F.when(is_ip(h), "").when(last2.isin(X.LONG_SUFFIXES), last2).otherwise(F.when(F.instr(h, ".") > 0, F.substring_index(h, ".", -1)).otherwise(""))


def url_parts(url: Column, suffix_: Column | None = None) -> dict[str, Column]:
    """The parts of a URL by name; ``suffix_`` is its host's public suffix, if a table of rules has told it."""
    h = host(url)
    s = suffix(h) if suffix_ is None else suffix_
    front = F.when(s == "", h).otherwise(F.left(h, F.length(h) - F.length(s) - 1))
    domain = F.when(is_ip(h), h).otherwise(F.substring_index(front, ".", -1))
    sub = F.when(is_ip(h) | (F.length(front) == F.length(domain)), "").otherwise(F.left(front, F.length(front) - F.length(domain) - 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        "subdomain": sub,
        "domain": domain,
        "suffix": s,
        "full_domain": F.when((s == "") | (domain == ""), "").otherwise(F.concat_ws(".", domain, s)),
        "path": rest,
        "query": F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1),
        "is_ip": is_ip(h),
    }


def bare_domain(c: Column) -> Column:
    """Whether a domain was given, and no URL."""
    return ~F.contains(c, F.lit("://")) & ~F.contains(c, F.lit("/"))


def looks_real(c: Column) -> Column:
    return F.coalesce((F.length(c) > 0) & ~F.contains(c, F.lit(" ")) & F.contains(c, F.lit(".")) & (F.length(c) <= 100) & ~c.rlike(r"^\p{Lu}\p{Ll}"), F.lit(False))


def signals(domain: Column, suffix_: Column, age_days: Column | None = None) -> Column:
    hyphens = F.length(domain) - F.length(F.replace(domain, F.lit("-"), F.lit("")))
    found = [
        F.when(suffix_.isin(X.SUSPICIOUS_SUFFIXES), F.concat(F.lit("suspicious_tld:"), suffix_)),
        F.when(hyphens >= X.MANY_HYPHENS, F.concat(F.lit("hyphen_heavy:"), hyphens.cast("string"), F.lit("_hyphens"))),
    ]
    if age_days is not None:
        found.append(F.when(age_days < X.NEW_DOMAIN_DAYS, F.concat(F.lit("new_domain:"), age_days.cast("string"), F.lit("_days_old"))))
    return F.array_compact(F.array(*found))


def title(html: Column) -> Column:
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), F.substring(stripped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, 200))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)


def meta_description(html: Column) -> Column:
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    wanted = F.filter(tags, lambda t: F.lower(_attribute(t, "name")) == "description")
    return F.when(F.size(wanted) > 0, F.substring(stripped(_attribute(F.get(wanted, F.lit(0)), "content")), 1, 300))


def absolute(base: Column, href: Column) -> Column:
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )


def icon_candidates(base: Column, html: Column) -> Column:
    """Array of (priority, pos, url, relation), best first."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    order = F.array(*map(F.lit, X.ICON_RELATIONS))
    found = F.transform(
        tags,
        lambda t, k: F.struct(
            F.array_position(order, F.lower(_attribute(t, "rel"))).cast("int").alias("priority"), k.alias("pos"), absolute(base, _attribute(t, "href")).alias("url"),
            F.lower(_attribute(t, "rel")).alias("relation"), (_attribute(t, "href") != "").alias("has"),
        ),
    )
    return F.array_sort(F.filter(found, lambda s: (s["priority"] > 0) & s["has"]))


def brands(*texts: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)))
    return F.filter(F.array(*map(F.lit, X.BRANDS)), lambda b: F.contains(text, b))


def mismatched(found: Column, domain: Column) -> Column:
    return F.filter(found, lambda b: ~F.contains(F.lower(domain), b))


def asn_key(asn: Column) -> Column:
    a = F.upper(F.trim(asn.cast("string")))
    return F.when(a.rlike(r"^\d+$"), F.concat(F.lit("AS"), a)).otherwise(a)


def ttl_weight(ttl: Column) -> Column:
    return F.when(F.coalesce(ttl, F.lit(0)) == 0, 0.5).otherwise(F.least(ttl, F.lit(3600)) / 3600)


def age_weight(days: Column) -> Column:
    return F.least(F.coalesce(days, F.lit(0)), F.lit(3650)) / 3650


def security_headers(headers: Column, present: bool = True) -> Column:
    wanted, names = F.array(*map(F.lit, X.SECURITY_HEADERS)), F.transform(F.map_keys(headers), F.lower)
    return F.array_intersect(wanted, names) if present else F.array_except(wanted, names)


def file_name(c: Column) -> Column:
    return F.translate(c, "./", "__")


def short_error(c: Column) -> Column:
    return F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric!r}")
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1 - dot(a, b) / norms)


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """1-based bin of equal width; the last one is closed, outside is null."""
    k = F.floor((value - low) / ((high - low) / bins)).cast("int") + 1
    return F.when((value >= low) & (value < high), k).when(value == high, bins)


def server(headers: Column) -> Column:
    """The server header, whatever its case."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == "server")), F.lit(0))


def joined(items: Column) -> Column:
    return F.concat_ws("|", items)


def layer_height(type_: Column, node: Column) -> Column:
    """Height in the layered layout: category, type, and up to 0.12 to either side by the node's hash."""
    from itertools import chain

    words = {t: X.LAYERS[c] + X.LAYER_OFFSETS[t] for t, c, _ in X.TYPE_WORDS}
    base = F.coalesce(F.element_at(F.create_map(*map(F.lit, chain.from_iterable(words.items()))), type_), F.lit(3.5))
    share = F.conv(F.substring(F.md5(node), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return base + (share * 2 - 1) * 0.12


def one_hot(type_: Column) -> Column:
    """Eight zeros and ones by the node's type; types that are not embedded count as unknown."""
    known = F.array(*map(F.lit, X.EMBEDDED_TYPES))
    shown = F.when(F.array_contains(known, type_), type_).otherwise("unknown")
    return F.transform(known, lambda t: (t == shown).cast("double"))
