"""URL algebra as Column expressions (no Python in the data path).

Every function takes a Column or a column name and returns a Column. A null URL gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The groups of RFC 3986, appendix B, each by a pattern of its own that reads no further than it must.
PARTS = {
    1: r"^([^:/?#]+):",
    2: r"^(?:[^:/?#]+:)?//([^/?#]*)",
    3: r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)",
    4: r"^[^?#]*\?([^#]*)",
    5: r"^[^#]*#([\s\S]*)$",
}

# Query parameters that the canonical form drops.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "ref", "referrer", "_ga", "_gid",
    "source", "campaign", "medium", "content", "term",
    "igshid", "ncid", "sr_share", "recruiter", "trk",
]

# Parameters that name what a page shows; they are kept, as all others are.
MEANINGFUL = ["id", "page", "p", "offset", "limit", "sort", "order", "category", "tag", "search", "q", "query", "filter"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(url: Column | str, n: int) -> Column:
    """Group n of the RFC split: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment; '' if absent."""
    return F.regexp_extract(_c(url), PARTS[n], 1)


def scheme(url: Column | str) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column | str) -> Column:
    return part(url, 2)


def domain(url: Column | str) -> Column:
    """Lower-cased authority, port and user info kept."""
    return F.lower(authority(url))


def host(url: Column | str) -> Column:
    """Lower-cased host without user info and port."""
    return F.lower(F.regexp_extract(_c(url), r"^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site(url: Column | str) -> Column:
    """host() without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column | str) -> Column:
    """Path without the ;params of its last segment."""
    return F.regexp_replace(part(url, 3), ";[^/]*$", "")


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_query(query: Column) -> Column:
    """Query with blank and tracking parameters dropped, sorted by name; values of a repeated name
    keep their order."""
    pairs = F.transform(
        F.split(query, "&"),
        lambda x, i: F.struct(_decode(F.substring_index(x, "=", 1)).alias("k"), i.alias("i"), F.when(F.instr(x, "=") > 0, _decode(F.regexp_extract(x, "^[^=]*=([\\s\\S]*)$", 1))).alias("v")),
    )
    kept = F.filter(pairs, lambda p: (F.coalesce(p["v"], F.lit("")) != "") & ~F.lower(p["k"]).isin(TRACKING))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def canonical(url: Column | str) -> Column:
    """The canonical form that decides whether two URLs are the same page: lower case, https where no
    scheme is given, no leading www., no trailing slashes (an empty path is /), no tracking or blank
    parameters, parameters sorted and re-encoded, no ;params, no fragment."""
    raw = _c(url)
    low = F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    whole = F.when(low.rlike(r"^[a-z][a-z0-9+.\-]*:"), low).otherwise(F.concat(F.lit("https://"), raw))
    net = F.regexp_replace(domain(whole), r"^www\.", "")
    p = F.regexp_replace(path(whole), "/+$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    q = canonical_query(part(whole, 4))
    return F.concat(scheme(whole), F.when((net == "") & ~scheme(whole).isin("http", "https"), F.lit(":")).otherwise(F.concat(F.lit("://"), net)), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def equivalent(a: Column | str, b: Column | str) -> Column:
    return canonical(a).eqNullSafe(canonical(b))


def without_dots(p: Column) -> Column:
    """A path with its . and .. segments resolved (RFC 3986, 5.2.4)."""
    seg = F.split(p, "/")
    done = F.aggregate(
        seg, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when((x == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", acc).otherwise(F.concat(acc, F.array(x))),
    )
    tail = F.when(F.element_at(seg, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(p.contains("/."), F.concat(F.array_join(done, "/"), tail)).otherwise(p)


def base_parts(base: Column) -> Column:
    """What resolving against a base needs of it, as a struct."""
    own = F.regexp_replace(part(base, 3), "[^/]*$", "")
    return F.struct(
        base.alias("whole"), part(base, 1).alias("scheme"), F.concat(part(base, 1), F.lit("://"), part(base, 2)).alias("root"), part(base, 3).alias("path"),
        F.when(own == "", F.lit("/")).otherwise(own).alias("folder"), F.regexp_replace(base, "#.*$", "").alias("page"),
    )


def resolve_at(b: Column, r: Column) -> Column:
    """resolve() with the base given as base_parts()."""
    after = F.regexp_extract(r, r"^[^?#]*(.*)$", 1)
    return (
        F.when(r == "", b["whole"])
        .when(r.startswith("/") & ~r.startswith("//"), F.concat(b["root"], without_dots(part(r, 3)), after))
        .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
        .when(r.startswith("//"), F.concat(b["scheme"], F.lit(":"), r))
        .when(r.startswith("?"), F.concat(b["root"], b["path"], r))
        .when(r.startswith("#"), F.concat(b["page"], r))
        .otherwise(F.concat(b["root"], without_dots(F.concat(b["folder"], part(r, 3))), after))
    )


def resolve(base: Column | str, ref: Column | str) -> Column:
    """ref as an absolute URL, seen from base (RFC 3986, 5.3); an empty ref is base itself."""
    return resolve_at(base_parts(_c(base)), _c(ref))


def resolve_all(base: Column, refs: Column) -> Column:
    """Each of an array of refs resolved; the base is taken apart once a row."""
    return F.element_at(F.transform(F.array(base_parts(base)), lambda b: F.transform(refs, lambda r: resolve_at(b, r))), 1)


def extension(url: Column | str) -> Column:
    """Text behind the last dot of the whole path, without the dot; '' where there is none."""
    p = part(url, 3)
    return F.when(F.instr(p, ".") > 0, F.lower(F.substring_index(p, ".", -1))).otherwise(F.lit(""))


def url_hash(url: Column | str) -> Column:
    return F.substring(F.md5(_c(url)), 1, 12)


def clean_domain(url: Column | str) -> Column:
    """Authority for use as a folder: every www. removed, : as _."""
    return F.replace(F.replace(authority(url), F.lit("www."), F.lit("")), F.lit(":"), F.lit("_"))


def css_filename(url: Column | str) -> Column:
    """Safe name of a style sheet's file: base name without .css, signs as _; hash for an empty path."""
    name = F.regexp_replace(F.substring_index(F.regexp_replace(part(url, 3), "/+$", ""), "/", -1), r"\.css$", "")
    return F.translate(F.when(part(url, 3) == "", url_hash(url)).otherwise(name), "./\\ :", "_____")


def retry_domain(url: Column | str) -> Column:
    """Domain as the retry policy keys it: what is between the first // and the next /."""
    u = _c(url)
    return F.when(F.instr(u, "//") > 0, F.split_part(F.split_part(u, F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))).otherwise(F.lit("unknown"))
