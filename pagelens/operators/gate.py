"""Gates and diagnostics: S2 URL allow-list gate, S5 refusal rows, F6 presence
gate, D1 auth check, Q4 action-list check.

The allow list is a small configuration list (bounded by what a person
writes), so it is applied as a literal array inside the expression: no join,
no broadcast of anything that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.url import url_host, url_hostport, url_path
from pagelens.operators.select import covered
from pagelens.operators.selectors import compile_selectors, match_selectors, split_list
from pagelens.schema import LOGGED_OUT_PATTERN

# Example allow list used by the registered gate query (hosts of the kind in `pages`).
DEMO_ALLOWED_HOSTS = ["*.example.net", "therwh.example.org", "localhost:8080"]

# Refusal texts of the URL gate.
REFUSE_INVALID = "Not a valid URL: {url}"
REFUSE_SCHEME = "Only http/https URLs are allowed (got scheme '{scheme}')."
REFUSE_UNSET = "allowed_hosts is empty. Pass a list of staging hostnames; opening pages is denied by default."
REFUSE_HOST = "Host '{host}' is not in allowed_hosts ({hosts})."


def normalize_hosts(hosts) -> list:
    return [h.strip().lower() for h in hosts if h and h.strip()]


def refusal(url: Column, hosts) -> Column:
    """Null when the URL may be opened, else the refusal text."""
    hosts = normalize_hosts(hosts)
    url = F.coalesce(url, F.lit(""))  # a missing url is refused like an empty one
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = url_host(url)
    hostport = url_hostport(url)
    valid = (scheme != "") & (~scheme.isin("http", "https") | (F.coalesce(host, F.lit("")) != ""))
    if hosts:
        entries = F.array(*[F.lit(h) for h in hosts])
        allowed = F.exists(entries, lambda e: F.when(e.startswith("*."),
                                                      host.endswith(F.substring(e, F.lit(2), F.length(e))) | (host == F.substring(e, F.lit(3), F.length(e))))
                           .when(F.instr(e, ":") > 0, hostport == e)
                           .otherwise(host == e))
        host_refusal = F.when(~allowed, F.replace(F.replace(F.lit(REFUSE_HOST), F.lit("{host}"), hostport),
                                                  F.lit("{hosts}"), F.lit(", ".join(hosts))))
    else:
        host_refusal = F.lit(REFUSE_UNSET)
    return (F.when(~valid, F.replace(F.lit(REFUSE_INVALID), F.lit("{url}"), url))
            .when(~scheme.isin("http", "https"), F.replace(F.lit(REFUSE_SCHEME), F.lit("{scheme}"), scheme))
            .otherwise(host_refusal))


def url_gate(pages: DataFrame, hosts) -> DataFrame:
    """One row per page: allowed flag and the refusal as an error struct."""
    r = refusal(F.col("url"), hosts)
    return pages.select(
        "page_id", "url", r.isNull().alias("allowed"),
        F.when(r.isNotNull(), F.lit("url_not_allowed")).alias("error_code"),
        r.alias("message"))


def split_allowed(pages: DataFrame, hosts):
    """(passed pages, refusals) — refused pages never reach the parse."""
    g = pages.withColumn("_refusal", refusal(F.col("url"), hosts))
    passed = g.filter(F.col("_refusal").isNull()).drop("_refusal")
    refused = g.filter(F.col("_refusal").isNotNull()).select(
        "page_id", "url", F.struct(F.lit("url_not_allowed").alias("code"), F.col("_refusal").alias("message"),
                                   F.lit(None).cast("string").alias("hint")).alias("error"))
    return passed, refused


def derived_fetch_log(pages: DataFrame) -> DataFrame:
    """A fetch log over every page url: the final url is the url itself, the url
    with a trailing slash, or the host's /login page (rotating by page_id)."""
    origin = F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    final = (F.when(F.col("page_id") % 3 == 0, F.col("url"))
             .when(F.col("page_id") % 3 == 1, F.concat(F.col("url"), F.lit("/")))
             .otherwise(F.concat(origin, F.lit("/login"))))
    return pages.select("page_id", F.col("url").alias("requested_url"), final.alias("final_url"))


def auth_check(log: DataFrame) -> DataFrame:
    """Redirected / looks_logged_out per fetch."""
    strip = lambda c: F.regexp_replace(c, r"/$", "")
    path = F.when(F.col("final_url").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), url_path(F.col("final_url"))) \
        .otherwise(F.col("final_url"))
    return log.select(
        "page_id", "requested_url", "final_url",
        (strip(F.col("final_url")) != strip(F.col("requested_url"))).alias("redirected"),
        F.coalesce(path.rlike(LOGGED_OUT_PATTERN), F.lit(False)).alias("looks_logged_out"))


# Texts of the presence-gate error row.
WAIT_SELECTOR_MESSAGE = "wait_selector '{selector}' did not appear within 15s."
WAIT_SELECTOR_HINT = "Verify the selector, or extract without it to inspect what the page actually contains."


SELECTOR_UNSUPPORTED = "wait_selector '{selector}' is not evaluated: {reason}."
SELECTOR_HINT = "Use tags, ids, classes, attributes, child positions, :not() / :is() and the combinators of CSS."


def presence(pages: DataFrame, elements: DataFrame, selectors: list[str], keep=lambda df: df) -> DataFrame:
    """F6 for several selectors at once: (page_id, url, selector, present, error), a row per page and selector.

    A selector list holds where any of its selectors matches an element of the main document, open shadow trees included. An
    error row says that the selector is absent, or that it is not evaluated at all.
    """
    spark = pages.sparkSession
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(selectors)], "no int, whole string")  # the caller's list
    items = compile_selectors(asked.select("no", "whole", F.posexplode_outer(split_list(F.col("whole"))).alias("item", "selector")))
    reason = F.first("reason", ignorenulls=True).alias("reason")
    state = items.groupBy("no", "whole").agg(reason)
    # one refused selector refuses its list
    usable = items.join(state.filter(F.col("reason").isNull()).select("no"), "no").select("no", "item", "steps")
    closed = covered(F.col("shadow_mode") == "closed", strict=True)
    main = elements.filter(F.col("frame_id") == 0).withColumn("_closed", closed).filter(~F.col("_closed")).drop("_closed")
    hits = match_selectors(main, usable, ["no", "item"], [], keep, pierce=True).select("page_id", "no").distinct().withColumn("hit", F.lit(True))
    rows = pages.select("page_id", "url", F.explode(F.array(*[F.lit(i) for i in range(len(selectors))])).alias("no"))
    rows = rows.join(F.broadcast(state), "no").join(hits, ["page_id", "no"], "left")
    text = lambda template, **of: _fill(F.lit(template), of)
    refused, absent = F.col("reason").isNotNull(), F.col("hit").isNull()
    error = F.when(refused, F.struct(F.lit("wait_selector_unsupported").alias("code"), text(SELECTOR_UNSUPPORTED, selector=F.col("whole"), reason=F.col("reason")).alias("message"),
                                     F.lit(SELECTOR_HINT).alias("hint"))) \
        .when(absent, F.struct(F.lit("wait_selector_timeout").alias("code"), text(WAIT_SELECTOR_MESSAGE, selector=F.col("whole")).alias("message"),
                               F.lit(WAIT_SELECTOR_HINT).alias("hint")))
    return rows.select("page_id", "url", F.col("whole").alias("selector"), (~refused & ~absent).alias("present"), error.alias("error"))


def _fill(template: Column, of: dict[str, Column]) -> Column:
    for name, value in of.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def presence_gate(pages: DataFrame, elements: DataFrame, selector: str, keep=lambda df: df):
    """(pages whose main document holds ``selector``, error rows of the others)."""
    found = presence(pages, elements, [selector], keep)
    passed = pages.join(found.filter("present").select("page_id"), "page_id", "left_semi")
    return passed, found.filter(~F.col("present")).select("page_id", "url", "error")
