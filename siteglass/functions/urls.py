"""URL operators as native column expressions.

A URL is taken apart by one regular-expression pass whose replacement joins the parts
with a separator; every form below is assembled from that array, so no Python runs.
``with_url`` binds the parts, so they are computed once however often a form uses them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from .select import JS_SPACE, let

# --- fixed values -----------------------------------------------------------
# Query parameters dropped by the strict form.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "fb_action_ids", "fb_action_types", "fb_source", "fb_ref",
    "gclid", "gclsrc", "dclid",
    "ref", "referrer", "_ga", "_gl", "mc_cid", "mc_eid",
    "igshid", "twclid", "li_fat_id",
    "mbid", "mkt_tok", "trk_contact", "trk_msg", "trk_module", "trk_sid",
)
# Patterns dropped by the crawl form when it resolves a canonical URL.
DEFAULT_IGNORE_PARAMS = ("utm_*", "fbclid", "gclid", "msclkid", "_ga", "mc_*", "ref", "source")
# Parameters that mark a paginated URL.
PAGINATION_PARAMS = ("page", "p", "offset", "start", "pg")
# ----------------------------------------------------------------------------

_SEP = "\x01"
# scheme, user info, host, port, path, ?query, #fragment of a hierarchical web URL
_WEB_URL = (
    r"^(?i)(https?|ftp|wss?):[/\\]*"
    r"((?:[^/\\?#]*@)?)"
    r"(\[[0-9a-f:.]+\]|[^:/\\?#@\[\]\s<>^|%]+)"
    r"(?::([0-9]*))?"
    r"((?:[/\\][^?#]*)?)"
    r"((?:\?[^#]*)?)"
    r"((?:#.*)?)$"
)
_JOINED = _SEP.join(f"${i}" for i in range(1, 8))
_TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]"
_PATH_UNSAFE = r"[^\x21-\x7e]|[\"<>`{}]"
_FRAGMENT_UNSAFE = r"[^\x21-\x7e]|[\"<>`]"
_QUERY_UNSAFE = r"[^\x21-\x7e]|[\"<>']"


def _percent_encode(text: Column, unsafe: str) -> Column:
    def encode(t: Column) -> Column:
        encoded = F.array_join(
            F.transform(
                F.split(t, ""),
                lambda c: F.when(c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c),
            ),
            "",
        )
        return F.when(t.rlike(unsafe), encoded).otherwise(t)

    return let(text, encode)


def _drop_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; only paths that have them pay for the fold."""

    def step(acc: Column, s: Column) -> Column:
        parent = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(s == ".", acc).when(s == "..", parent).otherwise(F.concat(acc, F.array(s)))

    def fold(p: Column) -> Column:
        kept = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
        folded = let(kept, lambda k: F.concat(
            k, F.when(p.rlike(r"(^|/)\.{1,2}$") | (k == ""), F.lit("/")).otherwise(F.lit(""))
        ))
        return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), folded).otherwise(p)

    return let(path, fold)


class Url:
    """Parts of one URL. All are null where it is not a web URL (``is_web`` false)."""

    def __init__(self, parts: Column):
        self.is_web = parts["scheme"].isNotNull()
        for name in ("scheme", "userinfo", "host", "port", "path", "query", "fragment"):
            setattr(self, name, parts[name])

    def origin(self, scheme: Column | None = None, port: Column | None = None) -> Column:
        port = self.port if port is None else port
        return F.concat(
            self.scheme if scheme is None else scheme,
            F.lit("://"),
            self.userinfo,
            self.host,
            F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        )

    def path_without_slash(self) -> Column:
        return F.when(
            (F.length(self.path) > 1) & self.path.endswith("/"),
            F.substring(self.path, F.lit(1), F.length(self.path) - 1),
        ).otherwise(self.path)

    def href(self) -> Column:
        """The URL as a browser would print it."""
        return F.concat(self.origin(), self.path, self.query, self.fragment)

    def params(self) -> Column:
        """Decoded query pairs: array<struct<k, v, pos>>."""
        pieces = F.filter(
            F.split(F.substring(self.query, F.lit(2), F.length(self.query)), "&"), lambda p: p != ""
        )

        def decode(x: Column) -> Column:
            return F.coalesce(F.try_url_decode(x), x)

        return F.transform(
            pieces,
            lambda p, i: F.struct(
                decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
                decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
                i.alias("pos"),
            ),
        )


def _split(url: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(url, _TRIM, ""), _WEB_URL, _JOINED), _SEP)


def _parts(pieces: Column) -> Column:
    scheme = F.lower(F.get(pieces, F.lit(0)))
    port = F.get(pieces, F.lit(3))
    default = (
        F.when(scheme.isin("http", "ws"), F.lit("80")).when(scheme.isin("https", "wss"), F.lit("443")).otherwise(F.lit("21"))
    )
    path = F.replace(F.get(pieces, F.lit(4)), F.lit("\\"), F.lit("/"))
    parts = F.struct(
        scheme.alias("scheme"),
        F.get(pieces, F.lit(1)).alias("userinfo"),
        F.lower(F.get(pieces, F.lit(2))).alias("host"),
        F.when((port == "") | (port == default), F.lit("")).otherwise(port).alias("port"),
        let(path, lambda p: F.when(p == "", F.lit("/")).otherwise(_percent_encode(_drop_dot_segments(p), _PATH_UNSAFE))).alias("path"),
        _percent_encode(F.get(pieces, F.lit(5)), _QUERY_UNSAFE).alias("query"),
        _percent_encode(F.get(pieces, F.lit(6)), _FRAGMENT_UNSAFE).alias("fragment"),
    )
    return F.when(F.size(pieces) == 7, parts)


def with_url(url: Column, body: Callable[[Url], Column]) -> Column:
    """Bind the parts of ``url`` once and build ``body`` from them."""
    return let(_split(url), lambda pieces: let(_parts(pieces), lambda parts: body(Url(parts))))


def _form_encode(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&"
    )


def _drop_params(pairs: Column, names: Sequence[str]) -> Column:
    exact = [n for n in names if "*" not in n]
    wild = [".*".join(_quote(s) for s in n.split("*")) for n in names if "*" in n]

    def keep(p: Column) -> Column:
        drop = F.lit(False)
        if exact:
            drop = drop | p["k"].isin(exact)
        if wild:
            drop = drop | p["k"].rlike("^(" + "|".join(wild) + ")$")
        return ~drop

    return F.filter(pairs, keep) if names else pairs


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()+?^$|" else c for c in text)


def _question(encoded: Column) -> Column:
    return F.when(encoded == "", F.lit("")).otherwise(F.concat(F.lit("?"), encoded))


def normalize_storage(url: Column) -> Column:
    """Storage form: lower-case host, no trailing slash; invalid URLs pass through."""
    return with_url(url, lambda u: F.when(
        u.is_web, F.concat(u.origin(), u.path_without_slash(), u.query, u.fragment)
    ).otherwise(url))


def normalize_crawl(
    url: Column,
    ignore_params: Sequence[str] = (),
    *,
    lowercase_host: bool = True,
    remove_trailing_slash: bool = True,
    sort_params: bool = True,
    remove_fragment: bool = True,
    remove_default_port: bool = True,
) -> Column:
    """Crawl form: sorted query, optional parameter ignore list; invalid URLs pass through.

    Parsing a web URL already lower-cases its host and drops its default port, so
    ``lowercase_host`` and ``remove_default_port`` change nothing; they are accepted options.
    """

    def build(u: Url) -> Column:
        pairs = _drop_params(u.params(), ignore_params)
        if sort_params:
            pairs = F.array_sort(F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), p["pos"].alias("pos"), p["v"].alias("v"))))
        query = F.when(F.length(u.query) > 1, let(_form_encode(pairs), _question)).otherwise(u.query)
        built = F.concat(
            u.origin(),
            u.path_without_slash() if remove_trailing_slash else u.path,
            query,
            F.lit("") if remove_fragment else u.fragment,
        )
        return F.when(u.is_web, built).otherwise(url)

    return with_url(url, build)


_SWAP_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def normalize_strict(url: Column) -> Column:
    """Strict form: https only, tracking parameters dropped, keys in dictionary order; else null."""

    def rank(p: Column) -> Column:
        return F.struct(
            F.lower(p["k"]).alias("fold"),
            F.translate(p["k"], _SWAP_FROM, _SWAP_FROM.swapcase()).alias("case"),
            p["pos"].alias("pos"),
            p["k"].alias("k"),
            p["v"].alias("v"),
        )

    def build(u: Url) -> Column:
        port = F.when(u.port == "443", F.lit("")).otherwise(u.port)
        pairs = F.array_sort(F.transform(_drop_params(u.params(), TRACKING_PARAMS), rank))
        query = F.when(F.length(u.query) > 1, let(_form_encode(pairs), _question)).otherwise(F.lit(""))
        built = F.concat(u.origin(F.lit("https"), port), u.path_without_slash(), query)
        return F.when(u.scheme.isin("http", "https"), built)

    return with_url(url, build)


def url_hash(url: Column) -> Column:
    """SHA-256 of the text as given (use a normalised URL)."""
    return F.sha2(url, 256)


def strict_url_hash(url: Column) -> Column:
    """SHA-256 of the strict form; null where there is none."""
    return F.sha2(normalize_strict(url), 256)


def has_pagination_params(url: Column) -> Column:
    pattern = r"[?&](" + "|".join(PAGINATION_PARAMS) + r")(=|&|$)"
    return with_url(url, lambda u: F.coalesce(u.query.rlike(pattern), F.lit(False)))


def equivalent(left: Column, right: Column, ignore_params: Sequence[str] = ()) -> Column:
    """Same URL in crawl form."""
    return normalize_crawl(left, ignore_params) == normalize_crawl(right, ignore_params)


def duplicates(left: Column, right: Column) -> Column:
    """Same URL in strict form; anything without a strict form is no duplicate."""
    return F.coalesce(normalize_strict(left) == normalize_strict(right), F.lit(False))


def host_of(url: Column) -> Column:
    """Lower-case host; null where the URL is not a web URL. One pass, no binding needed."""
    return F.when(F.size(_split(url)) == 7, F.lower(F.get(_split(url), F.lit(2))))


def path_of(url: Column) -> Column:
    return with_url(url, lambda u: u.path)


def same_host(url: Column, base: Column) -> Column:
    return F.coalesce(host_of(url) == host_of(base), F.lit(False))


def resolve(ref: Column, base: Column) -> Column:
    """Absolute form of a link found on page ``base``; null where it cannot be resolved."""

    def absolute(r: Column, b: Url) -> Column:
        folder = F.regexp_replace(b.path, "[^/]*$", "")
        tail = F.regexp_replace(r, r"^(?i)https?:", "")
        return (
            F.when(r.rlike(r"^(?i)https?:(?![/\\])"), F.concat(b.origin(), folder, tail))
            .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
            .when(r.rlike(r"^[/\\]{2}"), F.concat(b.scheme, F.lit(":"), r))
            .when(r.rlike(r"^[/\\]"), F.concat(b.origin(), r))
            .when(r.startswith("?"), F.concat(b.origin(), b.path, r))
            .when(r.startswith("#"), F.concat(b.origin(), b.path, b.query, r))
            .when(r == "", F.concat(b.origin(), b.path, b.query))
            .otherwise(F.concat(b.origin(), folder, r))
        )

    def finish(text: Column) -> Column:
        opaque = text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~text.rlike(r"^(?i)(https?|ftp|wss?):")
        return with_url(text, lambda a: F.when(a.is_web, a.href()).when(opaque, text))

    return with_url(base, lambda b: let(F.regexp_replace(ref, _TRIM, ""), lambda r: let(absolute(r, b), finish)))


_CANONICAL_TAG = r"(?i)(<link[^>]+rel=[\"']canonical[\"'][^>]*>)"
_OG_URL_TAG = r"(?i)(<meta[^>]+property=[\"']og:url[\"'][^>]*>)"
_HREF = r"(?i)href=[\"']([^\"']+)[\"']"
_CONTENT = r"(?i)content=[\"']([^\"']+)[\"']"


def _nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def canonical_from_html(html: Column, fallback: Column) -> Column:
    """Crawl form: canonical link, then og:url, then the fallback."""
    link = _nonempty(F.regexp_extract(F.regexp_extract(html, _CANONICAL_TAG, 1), _HREF, 1))
    og = _nonempty(F.regexp_extract(F.regexp_extract(html, _OG_URL_TAG, 1), _CONTENT, 1))
    return F.coalesce(link, og, fallback)


def canonical_link(html: Column) -> Column:
    """Strict form: href of the canonical link with attributes in either order, else null."""
    rel_first = r"(?i)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)[\"'][^>]*>"
    href_first = r"(?i)<link[^>]*href=[\"']([^\"']+)[\"'][^>]*rel=[\"']canonical[\"'][^>]*>"
    found = F.coalesce(
        _nonempty(F.regexp_extract(html, rel_first, 1)), _nonempty(F.regexp_extract(html, href_first, 1))
    )
    return _nonempty(F.regexp_replace(found, f"^{JS_SPACE}+|{JS_SPACE}+$", ""))


def resolve_canonical_crawl(
    url: Column, html: Column, ignore_params: Sequence[str] = DEFAULT_IGNORE_PARAMS
) -> Column:
    return normalize_crawl(canonical_from_html(html, url), ignore_params)


def resolve_canonical_strict(url: Column, html: Column) -> Column:
    """struct<url, is_canonical, original_url> in strict form."""

    def build(found: Column) -> Column:
        plain = F.struct(
            found["own"].alias("url"), F.lit(False).alias("is_canonical"), F.lit(None).cast("string").alias("original_url")
        )
        linked = F.struct(
            found["target"].alias("url"),
            F.coalesce(found["target"] == found["own"], F.lit(False)).alias("is_canonical"),
            found["own"].alias("original_url"),
        )
        return F.when(found["own"].isNotNull() & found["resolved"].isNotNull(), linked).otherwise(plain)

    def targets(resolved: Column) -> Column:
        return F.struct(
            normalize_strict(url).alias("own"), resolved.alias("resolved"), normalize_strict(resolved).alias("target")
        )

    return let(resolve(canonical_link(html), url), lambda resolved: let(targets(resolved), build))


def passes_patterns(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Plain substring patterns: any exclude loses; with includes given, one must match."""
    ok = F.lit(True)
    for pattern in exclude:
        ok = ok & ~url.contains(pattern)
    if include:
        hit = F.lit(False)
        for pattern in include:
            hit = hit | url.contains(pattern)
        ok = ok & hit
    return ok


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_slug(text: Column) -> Column:
    return text.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$")
