"""Cost build-up, bills of materials and rows of imported price sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.money import round_price
from tesserae.functions.text import lenient_number
from tesserae.session import materialise


@dataclass(frozen=True)
class Settings:
    hourly_rate: float = 0.0
    labor_hours: float = 0.0
    tool_cost: float = 0.0
    shipping: float = 0.0
    packaging: float = 0.0
    other_cost: float = 0.0
    overhead_per_item: float = 0.0
    fee_rate: float = 0.0
    target_margin: float = 0.0
    target_profit: float = 0.0
    round_rule: str = "whole"

    @classmethod
    def of_month(cls, income: float, hours: float, fixed: float, planned_output: float, total_quantity: float, **rest) -> Settings:
        """Rates from monthly figures: overhead is spread over the planned output, else over what there is."""
        return cls(hourly_rate=income / (hours or 1), overhead_per_item=fixed / (planned_output if planned_output > 0 else total_quantity or 1), **rest)


def positive(x: Column) -> Column:
    return F.coalesce(F.when(x > 0, x), F.lit(0.0))


def cost_model(rows: DataFrame, s: Settings) -> DataFrame:
    """Rows (quantity, unit_cost, and tool_cost, shipping, packaging, labor_hours, other_cost, null for the setting) with their prices and profits."""
    or_default = lambda name, value: F.coalesce(F.col(name), F.lit(value))
    zero = F.lit(0.0)
    keep, margin_room = 1 - s.fee_rate, 1 - s.fee_rate - s.target_margin
    by_profit = s.target_profit > 0
    out = rows.withColumns(
        {
            "quantity": F.coalesce(F.when(F.col("quantity") > 0, F.col("quantity")), F.lit(1.0)),
            "material_cost": F.coalesce("unit_cost", zero),
            "tool_cost": or_default("tool_cost", s.tool_cost),
            "shipping": or_default("shipping", s.shipping),
            "packaging": or_default("packaging", s.packaging),
            "labor_hours": or_default("labor_hours", s.labor_hours),
            "other_cost": or_default("other_cost", s.other_cost),
        }
    )
    out = out.withColumn("labor_cost", F.col("labor_hours") * s.hourly_rate)
    out = out.withColumn("fixed_cost", F.col("material_cost") + F.col("tool_cost") + F.col("shipping") + F.col("packaging") + F.col("labor_cost") + s.overhead_per_item + F.col("other_cost"))
    fixed = F.col("fixed_cost")
    raw = (fixed + s.target_profit) / keep if by_profit and keep > 0 else fixed / margin_room if not by_profit and margin_room > 0 else zero
    out = out.withColumns({"break_even": fixed / keep if keep > 0 else zero, "raw_price": raw})
    out = out.withColumn("price", round_price(F.col("raw_price"), s.round_rule))
    price = F.col("price")
    out = out.withColumn("fee", price * s.fee_rate).withColumn("profit", price - fixed - F.col("fee"))
    out = out.withColumn("margin", F.when(price > 0, F.col("profit") / price).otherwise(0.0))
    status = F.when(F.col("material_cost") == 0, "no cost")
    if not by_profit and margin_room <= 0:
        status = status.when(F.lit(True), "fee too high")
    status = status.when(price <= 0, "not computed")
    if not by_profit:
        status = status.when(F.col("margin") + 0.0001 < s.target_margin, "margin short")
    return out.withColumns(
        {
            "batch_profit": F.col("profit") * F.col("quantity"),
            "batch_revenue": price * F.col("quantity"),
            "purchase_total": F.col("material_cost") * F.col("quantity"),
            "material_share": F.when(fixed > 0, F.col("material_cost") / fixed).otherwise(0.0),
            "status": status.otherwise("ok"),
        }
    )


def usage(composition: DataFrame) -> DataFrame:
    """What each component is used in all, over the items (product, component_id, usage_qty)."""
    return composition.groupBy("product", "component_id").agg(F.sum(F.coalesce(F.when(F.col("usage_qty") > 0, F.col("usage_qty")), F.lit(1.0))).alias("used"))


def buildable(composition: DataFrame, components: DataFrame) -> DataFrame:
    """How many of each product its stock suffices for, its material cost, and its recipe; items of missing components are dropped.

    Components are (component_id, name, stock, unit_cost).
    """
    items = usage(composition).join(components, "component_id")
    per = F.floor(positive(F.col("stock")) / F.col("used")).cast("long")
    recipe = F.array_sort(F.collect_list(F.struct("component_id", F.concat(F.col("name"), F.lit(" x "), F.col("used").cast("long").cast("string")).alias("t"))))
    found = items.groupBy("product").agg(F.min(per).alias("buildable"), F.sum(F.col("used") * F.col("unit_cost")).alias("material_cost"), recipe.alias("r"))
    return found.select("product", "buildable", "material_cost", F.array_join(F.transform("r", lambda x: x["t"]), " + ").alias("recipe"))


def buildable_by_component(composition: DataFrame, components: DataFrame) -> DataFrame:
    """(component_id, used, buildable) of all components: how many times its stock suffices for all that the items use of it; null where none do."""
    used = composition.groupBy("component_id").agg(F.sum(positive(F.col("usage_qty"))).alias("used"))
    found = components.select("component_id", "stock").join(used, "component_id", "left").withColumn("used", F.coalesce("used", F.lit(0.0)))
    return found.select("component_id", "used", F.when(F.col("used") > 0, F.floor(positive(F.col("stock")) / F.col("used")).cast("long")).alias("buildable"))


def valid_items(composition: DataFrame, components: DataFrame) -> DataFrame:
    return composition.join(components, "component_id", "left_semi")


def first_unused(components: DataFrame, composition: DataFrame) -> DataFrame:
    """For each product (product, role, component_id), the smallest component id that it does not use: of its role (components' `type`), if there is one, else of any.

    An id is the first unused one if it follows, in the order of all ids of its type, as many as the product uses below it.
    So only the ids that a product uses are compared, and the one after them.
    """
    pairs = composition.select("product", "component_id").distinct()
    products = composition.groupBy("product").agg(F.min("role").alias("role"))

    def unused(of: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
        """(product, name): of the components (component_id, type), the first that each product (product, type) does not use."""
        most = pairs.groupBy("product").count().agg(F.max("count")).first()[0] or 0
        order = Window.partitionBy("type").orderBy("component_id")
        ranked = of.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most + 1)  # cut to so many in each task first
        used = pairs.join(wanted, "product").join(ranked, ["type", "component_id"])
        nth = F.row_number().over(Window.partitionBy("product").orderBy("place"))
        gap = used.withColumn("nth", nth).groupBy("product").agg(F.max(F.when(F.col("place") == F.col("nth"), F.col("nth"))).alias("last"))
        first = wanted.join(gap, "product", "left").withColumn("place", F.coalesce("last", F.lit(0)) + 1)
        return first.join(ranked, ["type", "place"]).select("product", F.col("component_id").alias(name))

    own = unused(components.select("component_id", "type"), products.select("product", F.col("role").alias("type")), "own")
    every = unused(components.select("component_id", F.lit("").alias("type")), products.select("product", F.lit("").alias("type")), "any")
    found = every.join(own, "product", "left")
    return found.select("product", F.coalesce("own", "any").alias("component_id"))


def totals(components: DataFrame) -> DataFrame:
    return components.agg(F.count("*").alias("n"), F.sum(positive(F.col("stock"))).alias("quantity"), F.sum(positive(F.col("stock")) * F.coalesce("unit_cost", F.lit(0.0))).alias("purchase"))


def component_type(name: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """The first class whose pattern is in the text, else the text, else the default."""
    out = None
    for pattern, value in patterns:
        out = (F if out is None else out).when(name.rlike(pattern), value)
    return out.when(F.length(F.trim(name)) > 0, F.trim(name)).otherwise(default)


#: The two types of components; words in a type and in a name that tell them.
MAIN, ACCESSORY = "主体", "配饰"
TYPE_WORDS = (("主|带|链|底|胚|包|绳", MAIN), ("配|饰|贴|扣|珠|吊坠|挂件|刺绣", ACCESSORY))
NAME_WORDS = (("织带|链条|主体|底托|包体|绳|主材", MAIN), ("刺绣|贴|配饰|吊坠|珠|扣|挂件", ACCESSORY))


def guessed_type(given: Column, name: Column, first: Column) -> Column:
    """A component's type: as it is given, in the words of the two types, else guessed from its name; without a hint the first row is the main part."""
    guess = F
    for words, kind in NAME_WORDS:
        guess = guess.when(name.rlike(words), kind)
    guess = guess.when(first, MAIN).otherwise(ACCESSORY)
    return component_type(F.coalesce(F.nullif(F.trim(given), F.lit("")), guess), TYPE_WORDS, ACCESSORY)


#: Signs that headings are compared without.
_LOOSE = "（）()【】[] \t_-/:：,，.。"
#: Lines of a sheet, blank ones not counted, among which a heading is looked for; and how many of the key fields it must name.
HEADING_LINES, HEADING_FIELDS = 12, 2


def _tidy(text: str) -> str:
    return "".join(c for c in text.strip().lower() if c not in _LOOSE)


def map_header(cells: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """For each field the first column whose heading equals, holds or is held by one of its aliases; -1 if there is none.

    An empty heading matches nothing.
    """
    heads = [_tidy(c or "") for c in cells]
    out = {}
    for field, names in aliases.items():
        wanted = [_tidy(n) for n in names]
        out[field] = next((i for i, h in enumerate(heads) if h and any(h == w or w in h or h in w for w in wanted)), -1)
    return out


def heading_places(cells: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """As map_header, as a struct with the place of each field in an array of cells."""
    heads = F.transform(cells, lambda c: F.translate(F.lower(F.trim(c)), _LOOSE, ""))
    names = {field: [_tidy(n) for n in of] for field, of in aliases.items()}

    def place(wanted: list[str]) -> Column:
        names = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
        hits = F.transform(heads, lambda h: (h != "") & F.exists(names, lambda w: F.contains(h, w) | F.contains(w, h)))
        return (F.array_position(hits, True) - 1).cast("int")

    return F.struct(*[place(wanted).alias(field) for field, wanted in names.items()])


def headings(lines: DataFrame, aliases: Mapping[str, Sequence[str]], key: Sequence[str], by: Sequence[str] = ("path",)) -> DataFrame:
    """(by, heading, places, first): of each sheet, the line of its heading with the place of each field, both null if it has none, and its first data line.

    Lines are (by, line, cells), blank ones left out. Only the first few of each sheet are looked at, and each task cuts its own
    to so many before they meet.
    """
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("line"))
    top = lines.withColumn("nth", nth).filter(F.col("nth") <= HEADING_LINES + 1).withColumn("places", heading_places(F.col("cells"), aliases))
    named = sum(((F.col(f"places.{k}") >= 0).cast("int") for k in key if k in aliases), F.lit(0))
    found = F.min(F.when((F.col("nth") <= HEADING_LINES) & (named >= HEADING_FIELDS), F.struct("nth", "line", "places")))
    each = top.groupBy(*by).agg(found.alias("found"), F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("top"))
    return each.select(*by, F.col("found.line").alias("heading"), "found.places", F.get("top", F.coalesce("found.nth", F.lit(0)))["line"].alias("first"))


def typed_rows(lines: DataFrame, aliases: Mapping[str, Sequence[str]], key: Sequence[str] = ("type", "name", "quantity", "unit_cost", "total_cost"), by: Sequence[str] = ("path",)) -> DataFrame:
    """Ragged lines (by, line, cells) of any number of sheets as records (by, line, type, name, quantity, unit_cost, ...).

    Each sheet has its own heading, looked for in its first 12 lines that are not blank, and its own columns; in a sheet without one,
    columns 0, 1, 2 are name, quantity, unit cost. Lines of a table without the columns `by` are one sheet.
    """
    by = [c for c in by if c in lines.columns]
    tidy = lines.select(*by, "line", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("cells")).filter(F.exists("cells", lambda c: c != ""))
    sheet = by or [F.lit(0).alias("sheet")]
    tidy = tidy.select(*sheet, "line", "cells")
    sheet = by or ["sheet"]
    found = materialise(headings(tidy, aliases, key, sheet), "headings")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}")) for c in sheet]
    data = tidy.alias("t").join(found.alias("h"), same).filter(F.col("heading").isNull() | (F.col("line") > F.col("heading")))
    data = data.select(*[F.col(f"t.{c}").alias(c) for c in sheet], "line", "cells", "heading", "places", "first")
    at = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    get = lambda f: F.coalesce(F.when(F.col(f"places.{f}") >= 0, at(F.col(f"places.{f}"))), F.lit("")) if f in aliases else F.lit("")
    pick = lambda f, i: F.when(get(f) != "", get(f)).otherwise(at(F.lit(i)))
    qty = F.coalesce(F.nullif(lenient_number(pick("quantity", 1)), F.lit(0.0)), F.lit(1.0))
    unit, total = lenient_number(pick("unit_cost", 2)), lenient_number(get("total_cost"))
    optional = [F.when(get(f) != "", lenient_number(get(f))).alias(f) for f in ("tool_cost", "shipping", "packaging", "labor_hours", "other_cost")]
    cost = F.when(unit != 0, unit).when((total > 0) & (qty > 0), total / qty).otherwise(0.0)
    name = F.when(pick("name", 0) != "", pick("name", 0)).otherwise(F.concat(F.lit("row "), F.col("line").cast("string")))
    kind = guessed_type(get("type"), name, F.col("line") == F.col("first"))
    return data.select(*by, "line", kind.alias("type"), name.alias("name"), qty.alias("quantity"), cost.alias("unit_cost"), *optional)
