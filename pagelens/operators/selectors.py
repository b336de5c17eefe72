"""CSS selectors: a compiler from selector text to steps, and set-at-a-time matching over the elements table.

``compile_selectors`` turns every selector of a column into steps (combinator, compound) with built-in string functions, so the
selectors of a whole corpus of style sheets are compiled in one projection. ``match_selectors`` finds the elements of every
step's compound by one equi join on its most selective part (id, else class, else tag, else attribute name) and then follows the
steps from left to right, all selectors at once, by structural joins on preorder intervals:

* descendant: a running maximum of ``last_eid`` over the matches of the step before reaches the element;
* child: semi join on ``parent_eid``;
* next sibling: semi join on (parent, place among its siblings);
* later sibling: join with the first match per parent.

No ancestor list is read and no pair of elements is built: a step costs one sort of its matches. There are as many rounds as the
longest selector has compounds.

Compounds: tag, ``*``, ``#id``, ``.class``, ``[attr]`` with ``= ~= |= ^= $= *=`` and the ``i`` flag, ``:not() :is() :where()`` of
compounds without combinators, the child and type positions (``:nth-child(an+b)`` and its kin), ``:root :empty :checked :disabled
:enabled :required :optional :link :any-link``. ``:hover``, ``:focus`` and other states that need a user, and pseudo-elements, match
no element of a capture. Everything else is not evaluated: such a selector has ``reason`` set, and callers report it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.props import A
from pagelens.functions.text import JS_WS
from pagelens.operators.select import FRAME

_IDENT = r"(?:[A-Za-z0-9_-]++|[^\x00-\x7F]++|\\.)++"
_TEXT = r"\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'"
_ATTR = rf"\[(?:[^\]\"']++|{_TEXT})*+\]"
_ARGS = rf"\((?:[^()\"'\[\]]++|{_TEXT}|{_ATTR}|\((?:[^()\"']++|{_TEXT})*+\))*+\)"
_PSEUDO = rf"::?{_IDENT}(?:{_ARGS})?+"
_PART = rf"#{_IDENT}|\.{_IDENT}|{_ATTR}|{_PSEUDO}"
_COMPOUND = rf"^(?=.)(?:\*|{_IDENT})?+(?:{_PART})*+$"
_ITEM = rf"(?:[^,\[\]()\"']++|{_TEXT}|{_ATTR}|{_ARGS})++"
_STEP = rf"\s*+[>+~]\s*+|\s++|(?:[^\s>+~\[\]()\"']++|{_ATTR}|{_ARGS})++"
# one selector of more characters is reported, not compiled: its nesting could exceed a regular expression's stack
LONGEST = 4096

# Pseudo-classes by what they need.
POSITIONS = ["nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"]
FIRST_LAST = {"first-child": ["nth-child"], "last-child": ["nth-last-child"], "only-child": ["nth-child", "nth-last-child"],
              "first-of-type": ["nth-of-type"], "last-of-type": ["nth-last-of-type"], "only-of-type": ["nth-of-type", "nth-last-of-type"]}
STATES = ["root", "empty", "checked", "disabled", "enabled", "required", "optional", "link", "any-link"]
NEVER = ["hover", "focus", "focus-within", "focus-visible", "active", "visited", "target", "before", "after", "first-line", "first-letter"]
LISTS = ["not", "is", "where"]
FIELD_TAGS = ["button", "input", "select", "textarea", "option", "optgroup", "fieldset"]

SIMPLE = ("struct<tag:string,ids:array<string>,classes:array<string>,attrs:array<struct<name:string,op:string,value:string,loose:boolean>>,"
          "tests:array<struct<name:string,a:int,b:int>>,never:boolean,weight:bigint>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_list(selectors: Column) -> Column:
    """The selectors of a comma-separated list; commas inside brackets and quotes do not count."""
    plain = ~selectors.rlike(r"[\[(\"']")
    items = F.when(plain, F.split(selectors, ",")).otherwise(F.regexp_extract_all(selectors, F.lit(_ITEM), 0))
    # a list with an empty place or an open bracket stays whole, and is refused as such
    sound = lambda i: (F.array_join(i, ",") == selectors) & ~F.exists(i, lambda s: F.trim(s) == "")
    items = _let(items, lambda i: F.when(sound(i), i).otherwise(F.array(selectors)))
    return F.filter(F.transform(items, lambda s: F.trim(F.regexp_replace(s, JS_WS, " "))), lambda s: s != "")


def _bare(c: Column) -> Column:
    """An identifier without its escapes."""
    return F.regexp_replace(c, r"\\(.)", "$1")


def _attr(part: Column) -> Column:
    body = F.substring(part, F.lit(2), F.length(part) - 2)
    name = r"^\s*([^\s~|^$*=]+)\s*"

    def of(value: Column) -> Column:
        quoted = F.regexp_extract(value, r"^(?s:([\"'])(.*)\1)\s*[iIsS]?$", 2)
        word = F.regexp_replace(value, r"\s+[iIsS]$", "")
        return F.struct(F.lower(F.regexp_extract(body, name, 1)).alias("name"),
                        F.regexp_extract(body, name + r"([~|^$*]?=)", 2).alias("op"),
                        _bare(F.when(value.rlike(r"^[\"']"), quoted).otherwise(word)).alias("value"),
                        value.rlike(r"(?s)[\"'\s]\s*[iI]$").alias("loose"))

    return _let(F.regexp_extract(body, name + r"[~|^$*]?=\s*(?s:(.*?))\s*$", 2), of)


def _nth(p: Column) -> Column:
    """(name, a, b) of a position with the argument an+b."""
    def of(arg: Column) -> Column:
        step, offset = F.regexp_extract(arg, r"^([+-]?\d{0,9})n", 1), F.regexp_extract(arg, r"n([+-]\d{1,9})$", 1)
        periodic = arg.contains("n")
        a = F.when(~periodic, F.lit(0)).otherwise(_let(step, lambda s: F.when(s.isin("", "+"), F.lit(1)).when(s == "-", F.lit(-1)).otherwise(s.try_cast("int"))))
        b = F.when(~periodic, arg.try_cast("int")).otherwise(F.coalesce(offset.try_cast("int"), F.lit(0)))
        return F.struct(p["name"].alias("name"), a.alias("a"), b.alias("b"))

    arg = F.lower(F.regexp_replace(p["arg"], r"\s+", ""))
    return _let(F.replace(F.replace(arg, F.lit("odd"), F.lit("2n+1")), F.lit("even"), F.lit("2n")), of)


_AN_B = r"(?i)^\s*(?:odd|even|[+-]?\d{1,9}|[+-]?\d{0,9}n\s*(?:[+-]\s*\d{1,9})?)\s*$"


def _unit(compound: Column) -> Column:
    """A compound cut into its parts: (text, tag, parts, pseudos); the pseudos are (element, name, arg), arg null without brackets."""
    pseudo = lambda p: F.struct(
        p.startswith("::").alias("element"), F.lower(F.regexp_extract(p, r"^::?([^(]+)", 1)).alias("name"),
        F.when(p.contains("("), F.regexp_extract(p, r"^(?s::[^(]+\((.*)\)$)", 1)).alias("arg"))
    return _let(F.regexp_extract_all(compound, F.lit(_PART), 0), lambda parts: F.struct(
        compound.alias("text"), _bare(F.regexp_extract(compound, rf"^(\*|{_IDENT})", 1)).alias("tag"), parts.alias("parts"),
        F.transform(F.filter(parts, lambda p: p.startswith(":")), pseudo).alias("pseudos")))


def _is_list(p: Column) -> Column:
    return ~p["element"] & p["name"].isin(LISTS) & p["arg"].isNotNull()


def _known(unit: Column, lists: bool) -> Column:
    known = lambda p: (p["element"] | (p["arg"].isNull() & p["name"].isin(*FIRST_LAST, *STATES, *NEVER))
                       | F.coalesce(p["name"].isin(POSITIONS) & p["arg"].rlike(_AN_B), F.lit(False)) | (_is_list(p) if lists else F.lit(False)))
    return unit["text"].rlike(_COMPOUND) & F.forall(unit["pseudos"], known)


def _simple(unit: Column) -> Column:
    """A compound without its lists, as SIMPLE."""
    pick = lambda lead: F.filter(unit["parts"], lambda p: p.startswith(lead))
    names = lambda lead: F.transform(pick(lead), lambda p: _bare(F.substring(p, F.lit(2), F.length(p))))
    expand = F.create_map(*[x for k, v in FIRST_LAST.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    test = lambda name, b: F.struct(name.alias("name"), F.lit(0).alias("a"), F.lit(b).alias("b"))

    def of(pseudos: Column) -> Column:
        named = lambda known: F.filter(pseudos, lambda p: p["name"].isin(*known) & ~p["element"])
        tests = F.concat(F.flatten(F.transform(named(FIRST_LAST), lambda p: F.transform(expand[p["name"]], lambda n: test(n, 1)))),
                         F.transform(named(POSITIONS), _nth), F.transform(named(STATES), lambda p: test(p["name"], 0)))
        elements = F.size(F.filter(pseudos, lambda p: p["element"]))
        classes = F.size(pick(".")) + F.size(pick("[")) + F.size(pseudos) - elements
        weight = F.size(pick("#")) * F.lit(1_000_000) + classes * 1000 + elements + F.when(unit["tag"].isin("", "*"), 0).otherwise(1)
        return F.struct(
            F.when(~unit["tag"].isin("", "*"), F.lower(unit["tag"])).alias("tag"), names("#").alias("ids"), names(".").alias("classes"),
            F.transform(pick("["), _attr).alias("attrs"), tests.alias("tests"),
            F.exists(pseudos, lambda p: p["element"] | p["name"].isin(NEVER)).alias("never"), weight.cast("long").alias("weight")).cast(SIMPLE)

    return _let(F.filter(unit["pseudos"], lambda p: ~_is_list(p)), of)


def compile_selectors(df: DataFrame, selector: str = "selector") -> DataFrame:
    """Adds ``steps`` (array of combinator and compound, left to right), ``weight`` (specificity) and ``reason`` (why a selector is not
    evaluated, else null; its steps are null). A null or empty selector has a reason."""
    text = F.trim(F.col(selector))
    df = df.withColumn("_tok", F.when(F.length(text) <= LONGEST, F.regexp_extract_all(text, F.lit(_STEP), 0)))
    df = df.withColumns({
        "_whole": F.coalesce((F.array_join("_tok", "") == text) & (F.size("_tok") % 2 == 1), F.lit(False)),
        "_units": F.transform(F.filter("_tok", lambda t, i: i % 2 == 0), _unit),
        "_combs": F.transform(F.filter("_tok", lambda t, i: i % 2 == 1), lambda t: F.when(F.trim(t) == "", F.lit(" ")).otherwise(F.trim(t)))})
    listed = lambda u: F.transform(F.filter(u["pseudos"], _is_list), lambda p: F.struct(
        p["name"].alias("name"), F.transform(split_list(p["arg"]), _unit).alias("items")))
    df = df.withColumn("_lists", F.transform("_units", listed))
    sound = lambda u: u["text"].rlike(_COMPOUND)
    inner = F.forall("_lists", lambda ls: F.forall(ls, lambda x: (F.size(x["items"]) > 0) & F.forall(x["items"], lambda u: _known(u, False))))
    reason = (F.when(text.isNull() | (text == ""), F.lit("empty selector"))
              .when(F.length(text) > LONGEST, F.lit(f"longer than {LONGEST} characters"))
              .when(~F.col("_whole") | ~F.forall("_units", sound) | ~F.forall("_combs", lambda t: t.isin(" ", ">", "+", "~")), F.lit("not a selector"))
              .when(~F.forall("_units", lambda u: _known(u, True)) | ~inner, F.lit("pseudo-class not evaluated")))
    df = df.withColumn("reason", reason)
    df = df.withColumn("_simple", F.when(F.col("reason").isNull(), F.transform("_units", _simple)))
    df = df.withColumn("_inner", F.when(F.col("reason").isNull(), F.transform("_lists", lambda ls: F.transform(ls, lambda x: F.struct(
        x["name"].alias("name"), F.transform(x["items"], _simple).alias("items"))))))

    def step(c: Column, i: Column) -> Column:
        of = lambda *names: F.transform(F.filter(F.get("_inner", i), lambda x: x["name"].isin(*names)), lambda x: x["items"])
        return F.struct(F.when(i > 0, F.get("_combs", i - 1)).otherwise(F.lit("")).alias("comb"), c.alias("c"), of("not").alias("nots"), of("is", "where").alias("anys"))

    heaviest = lambda x: F.when(x["name"] != "where", F.array_max(F.transform(x["items"], lambda c: c["weight"]))).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    weight = F.aggregate("_simple", zero, lambda t, c: t + c["weight"]) + F.aggregate(F.flatten("_inner"), zero, lambda t, x: t + heaviest(x))
    return (df.withColumn("steps", F.transform("_simple", step)).withColumn("weight", weight)
            .drop("_tok", "_whole", "_units", "_combs", "_lists", "_simple", "_inner"))


# ---------------------------------------------------------------------------
# matching
# ---------------------------------------------------------------------------
def _attr_holds(a: Column, attrs: Column) -> Column:
    have, want = attrs[a["name"]], a["value"]
    have, want = F.when(a["loose"], F.lower(have)).otherwise(have), F.when(a["loose"], F.lower(want)).otherwise(want)
    op = a["op"]
    held = (F.when(op == "", F.lit(True)).when(op == "=", have == want).when(op == "~=", F.array_contains(F.split(F.trim(have), JS_WS), want))
            .when(op == "|=", (have == want) | have.startswith(F.concat(want, F.lit("-")))).when(want == "", F.lit(False))
            .when(op == "^=", have.startswith(want)).when(op == "$=", have.endswith(want)).otherwise(have.contains(want)))
    return have.isNotNull() & F.coalesce(held, F.lit(False))


def _test_holds(t: Column) -> Column:
    place = (F.when(t["name"] == "nth-child", F.col("sib_index")).when(t["name"] == "nth-last-child", F.col("sib_last"))
             .when(t["name"] == "nth-of-type", F.col("type_index")).otherwise(F.col("type_last")))
    steps = place - t["b"]
    nth = F.when(t["a"] == 0, steps == 0).otherwise((steps % t["a"] == 0) & (steps / t["a"] >= 0))
    field, off = F.col("tag").isin(FIELD_TAGS), A["disabled"].isNotNull()
    asks = F.col("tag").isin("input", "select", "textarea")
    state = (F.when(t["name"] == "root", F.col("tag") == "html").when(t["name"] == "empty", F.col("childless"))
             .when(t["name"] == "checked", (F.col("tag").isin("input") & A["checked"].isNotNull()) | ((F.col("tag") == "option") & A["selected"].isNotNull()))
             .when(t["name"] == "disabled", field & off).when(t["name"] == "enabled", field & ~off)
             .when(t["name"] == "required", asks & A["required"].isNotNull()).when(t["name"] == "optional", asks & A["required"].isNull())
             .otherwise(F.col("tag").isin("a", "area", "link") & A["href"].isNotNull()))
    return F.coalesce(F.when(t["name"].isin(POSITIONS), nth).otherwise(state), F.lit(False))


def _holds(c: Column) -> Column:
    """The element of the row meets the compound ``c`` (SIMPLE)."""
    return (~c["never"] & (c["tag"].isNull() | (c["tag"] == F.col("tag"))) & F.forall(c["ids"], lambda i: F.coalesce(A["id"] == i, F.lit(False)))
            & (F.size(F.array_except(c["classes"], F.col("classes"))) == 0) & F.forall(c["attrs"], lambda a: _attr_holds(a, F.col("attrs")))
            & F.forall(c["tests"], _test_holds))


def _key(c: Column) -> Column:
    """The most selective part of a compound, as the elements' keys are written."""
    return (F.when(F.size(c["ids"]) > 0, F.concat(F.lit("#"), F.get(c["ids"], F.lit(0))))
            .when(F.size(c["classes"]) > 0, F.concat(F.lit("."), F.get(c["classes"], F.lit(0))))
            .when(c["tag"].isNotNull(), F.concat(F.lit("<"), c["tag"]))
            .when(F.size(c["attrs"]) > 0, F.concat(F.lit("["), F.get(F.transform(c["attrs"], lambda a: a["name"]), F.lit(0))))
            .otherwise(F.lit("*")))


def _features(elements: DataFrame) -> DataFrame:
    """Elements with their classes and places among siblings (one sort per parent)."""
    w = Window.partitionBy(*FRAME, "root_id", "_parent")
    t = Window.partitionBy(*FRAME, "root_id", "_parent", "tag")
    classes = F.array_distinct(F.filter(F.split(F.coalesce(A["class"], F.lit("")), JS_WS), lambda c: c != ""))
    return (elements.select(*FRAME, "eid", F.coalesce("parent_eid", F.lit(-1)).alias("_parent"), "last_eid", "root_id", "tag", "attrs", "sib_index",
                            classes.alias("classes"), ((F.col("last_eid") == F.col("eid")) & (F.col("t_end") <= F.col("t_start"))).alias("childless"))
            .withColumns({"sib_last": F.count(F.lit(1)).over(w) - F.col("sib_index") + 1,
                          "type_index": F.row_number().over(t.orderBy("eid")), "_types": F.count(F.lit(1)).over(t)})
            .withColumn("type_last", F.col("_types") - F.col("type_index") + 1).drop("_types"))


def match_selectors(elements: DataFrame, selectors: DataFrame, ids: list[str], scope: list[str], keep: Callable[[DataFrame], DataFrame],
                    pierce: bool = False) -> DataFrame:
    """(page_id, frame_id, ids..., eid) of every element that a selector matches.

    ``selectors``: compiled rows with the columns ``ids`` (their key within ``scope``), ``scope`` (page_id, frame_id, root_id of the elements
    they apply to; empty: every frame) and ``steps``; rows without steps match nothing. With ``pierce`` relations cross shadow roots, else they
    stay inside one. ``keep`` materialises a table that several steps read.
    """
    root = [] if pierce else ["root_id"]
    steps = selectors.filter(F.col("steps").isNotNull()).select(*scope, *ids, F.size("steps").alias("n_steps"), F.posexplode("steps").alias("step", "s"))
    steps = steps.select(*scope, *ids, "n_steps", "step", "s.comb", "s.c", "s.nots", "s.anys", _key(F.col("s.c")).alias("key"))
    shape = {(r["step"], r["comb"]) for r in steps.select("step", "comb").distinct().collect()}  # places x combinators of the longest selector
    el = elements if not scope else elements.join(steps.select(*scope).distinct(), scope, "left_semi")
    el = _features(el)
    keys = F.concat(F.array(F.lit("*"), F.concat(F.lit("<"), F.col("tag"))), F.transform("classes", lambda c: F.concat(F.lit("."), c)),
                    F.transform(F.map_keys("attrs"), lambda k: F.concat(F.lit("["), k)),
                    F.when(A["id"].isNotNull(), F.array(F.concat(F.lit("#"), A["id"]))).otherwise(F.array().cast("array<string>")))
    narrow = el.select(*FRAME, "root_id", "eid", F.explode(F.array_distinct(keys)).alias("key"))
    wanted = steps if scope else F.broadcast(steps)  # without a scope: the caller's few selectors
    met = narrow.join(wanted, [*scope, "key"])
    met = met.join(el.drop("root_id"), FRAME + ["eid"])
    listed = F.forall("nots", lambda n: ~F.exists(n, _holds)) & F.forall("anys", lambda n: F.exists(n, _holds))
    met = met.filter(_holds(F.col("c")) & listed).select(*FRAME, "root_id", *ids, "step", "comb", "n_steps", "eid", "_parent", "last_eid", "sib_index")
    last = max((s for s, _ in shape), default=0)
    if last:
        met = keep(met)
    unit = [*FRAME, *root, *ids]
    found = met.filter("step = 0")
    done = found.filter("n_steps = 1")
    for step in range(1, last + 1):
        at = met.filter(F.col("step") == step)
        parts = []
        for comb in sorted(c for s, c in shape if s == step):
            right, left = at.filter(F.col("comb") == comb), found
            if comb == " ":
                w = Window.partitionBy(*unit).orderBy("eid", "_left").rowsBetween(Window.unboundedPreceding, -1)
                both = right.withColumn("_left", F.lit(0)).unionByName(left.withColumn("_left", F.lit(1)))
                reach = F.max(F.when(F.col("_left") == 1, F.col("last_eid"))).over(w)
                parts.append(both.withColumn("_reach", reach).filter((F.col("_left") == 0) & (F.col("_reach") >= F.col("eid"))).drop("_left", "_reach"))
            elif comb == ">":
                parts.append(right.join(left.select(*unit, F.col("eid").alias("_parent")), [*unit, "_parent"], "left_semi"))
            elif comb == "+":
                parts.append(right.join(left.select(*unit, "_parent", (F.col("sib_index") + 1).alias("sib_index")), [*unit, "_parent", "sib_index"], "left_semi"))
            else:
                first = left.groupBy(*unit, "_parent").agg(F.min("sib_index").alias("_first"))
                parts.append(right.join(first, [*unit, "_parent"]).filter(F.col("_first") < F.col("sib_index")).drop("_first"))
        found = parts[0].select(*met.columns)
        for p in parts[1:]:
            found = found.unionByName(p.select(*met.columns))
        if step < last and step % 4 == 0:
            found = keep(found)
        done = done.unionByName(found.filter(F.col("n_steps") == step + 1))
    return done.select(*FRAME, *ids, "eid")
