"""URL column functions: P8 link resolution and host / path parts.

Resolution follows the URL standard for the cases that occur in captured
pages: absolute http(s) URLs, scheme-relative, root-relative, query-only,
fragment-only, empty and path-relative references with dot segments;
backslashes count as slashes; non-ASCII and the few ASCII characters of the
path / query / fragment percent-encode sets are UTF-8 percent-encoded.
Hosts are lower-cased and default ports dropped; IDNA is not applied.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTH = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed one time, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _encode_set(c: Column, ascii_class: str) -> Column:
    """Percent-encode non-ASCII characters and the ASCII ones in ``ascii_class``. Text without any is not taken apart."""
    to_encode = r"[^\x00-\x7F]|" + ascii_class
    encoded = lambda x: F.array_join(
        F.transform(
            F.split(x, ""),
            lambda ch: F.when(ch.rlike(to_encode), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch),
        ),
        "",
    )
    return _once(c, lambda x: F.when(x.rlike(to_encode), encoded(x)).otherwise(x))


def encode_path(c: Column) -> Column:
    return _encode_set(c, r"[ \"<>`{}\x00-\x1F\x7F]")


def encode_query(c: Column) -> Column:
    return _encode_set(c, r"[ \"<>'\x00-\x1F\x7F]")


def encode_fragment(c: Column) -> Column:
    return _encode_set(c, r"[ \"<>`\x00-\x1F\x7F]")


def remove_dot_segments(path: Column) -> Column:
    """'/a/b/../c/./d' -> '/a/c/d'; a trailing '.' or '..' leaves a trailing '/'. A path without such segments is not taken apart."""
    return _once(F.concat(F.lit("/"), F.substring(path, 2, 1 << 30)),
                 lambda p: F.when(F.contains(p, F.lit("/.")), _without_dots(p)).otherwise(p))


def _without_dots(path: Column) -> Column:
    segs = F.split(F.substring(path, 2, 1 << 30), "/")
    last = F.element_at(segs, -1)
    segs = F.when(last.isin(".", ".."), F.concat(segs, F.array(F.lit("")))).otherwise(segs)
    acc = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda a, s: F.when(s == ".", a)
        .when(s == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
              .otherwise(a))
        .otherwise(F.concat(a, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(acc, "/"))


def _split_url(u: Column):
    """(scheme, authority, path, query, fragment) of an absolute hierarchical URL."""
    scheme = F.lower(F.regexp_extract(u, _AUTH, 1))
    auth = F.regexp_extract(u, _AUTH, 2)
    rest = F.regexp_replace(u, _AUTH, "")
    frag = F.when(F.instr(rest, "#") > 0, F.substring_index(rest, "#", -1 * 1))
    before_frag = F.substring_index(rest, "#", 1)
    query = F.when(F.instr(before_frag, "?") > 0, F.regexp_extract(before_frag, r"\?(.*)$", 1))
    path = F.substring_index(before_frag, "?", 1)
    return scheme, auth, path, query, frag


def _fragment_of(s: Column) -> Column:
    return F.when(F.instr(s, "#") > 0, F.regexp_extract(s, r"#(.*)$", 1))


def _normalize_authority(scheme: Column, auth: Column) -> Column:
    hostport = F.lower(F.regexp_replace(auth, r"^.*@", ""))
    return F.when((scheme == "http") & hostport.endswith(":80"), F.regexp_replace(hostport, r":80$", "")) \
        .when((scheme == "https") & hostport.endswith(":443"), F.regexp_replace(hostport, r":443$", "")) \
        .otherwise(hostport)


def _serialize(scheme, auth, path, query, frag) -> Column:
    path = F.when((path == "") | path.isNull(), F.lit("/")).otherwise(path)
    return F.concat(
        scheme, F.lit("://"), _normalize_authority(scheme, auth),
        encode_path(remove_dot_segments(path)),
        F.when(query.isNotNull(), F.concat(F.lit("?"), encode_query(query))).otherwise(F.lit("")),
        F.when(frag.isNotNull(), F.concat(F.lit("#"), encode_fragment(frag))).otherwise(F.lit("")),
    )


def resolve_href(href: Column, base: Column) -> Column:
    """Absolute URL of ``href`` against an absolute http(s) ``base`` (what ``a.href`` returns).

    Non-hierarchical schemes (mailto:, tel:, javascript:) are returned as written.
    The reference is first turned into one absolute (unnormalised) URL string,
    which is then split and serialised once.
    """
    h = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    h2 = F.regexp_replace(h, r"\\", "/")
    hs = F.lower(F.regexp_extract(h, _SCHEME, 1))
    special = hs.isin("http", "https", "ws", "wss", "ftp", "file")
    b_scheme = F.lower(F.regexp_extract(base, _AUTH, 1))
    b_prefix = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    b_nofrag = F.substring_index(base, "#", 1)
    b_noquery = F.substring_index(b_nofrag, "?", 1)
    b_path = F.substring(b_noquery, F.length(b_prefix) + 1, 1 << 30)
    b_dir = F.regexp_replace(F.when(b_path == "", F.lit("/")).otherwise(b_path), r"[^/]*$", "")
    no_scheme = F.regexp_replace(h2, _SCHEME, "")
    absolute = F.concat(hs, F.lit("://"), F.regexp_replace(no_scheme, r"^/*", ""))
    target = (
        F.when((hs != "") & special & ((hs != b_scheme) | h2.rlike(_SCHEME + "/")), absolute)
        .when(hs != "", F.concat(b_prefix, b_dir, no_scheme))
        .when(h2.startswith("//"), F.concat(b_scheme, F.lit(":"), h2))
        .when(h2.startswith("/"), F.concat(b_prefix, h2))
        .when(h2.startswith("?"), F.concat(b_noquery, h2))
        .when(h2.startswith("#"), F.concat(b_nofrag, h2))
        .when(h2 == "", b_nofrag)
        .otherwise(F.concat(b_prefix, b_dir, h2))
    )
    return F.when((hs != "") & ~special, h).otherwise(normalize_url(target))


def normalize_url(u: Column) -> Column:
    """Serialise an absolute hierarchical URL: lower-case scheme / host, default
    port dropped, dot segments removed, percent-encoding of each part."""
    return _once(u, lambda x: _serialize(*_split_url(x)))


def url_host(u: Column) -> Column:
    """Lower-cased host (without port) of an http(s) URL, else null."""
    return F.lower(F.nullif(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1), F.lit("")))


def url_hostport(u: Column) -> Column:
    """Lower-cased host[:port] with the default port of the scheme removed."""
    scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
    auth = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return _normalize_authority(scheme, auth)


def url_path(u: Column) -> Column:
    _, _, path, _, _ = _split_url(u)
    return F.when(path == "", F.lit("/")).otherwise(path)


def url_origin(u: Column) -> Column:
    scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.concat(scheme, F.lit("://"), url_hostport(u)))
