"""Sizes, pages, labels and small lookups of boards, sessions and imports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import clock
from tesserae.functions.color import half_up

#: Dots per inch and bead size of prints; bounds of a board's side and of a provider's timeout.
DPI, BEAD_CM = 300, 0.26
SIDE = (10, 1000)
TIMEOUT_MS = (3000, 30000, 15000)


def mm_to_px(mm: Column) -> Column:
    return half_up(mm * F.lit(float(DPI)) / F.lit(25.4)).cast("int")


def finished_cm(cells: Column) -> Column:
    return F.round(cells * F.lit(BEAD_CM), 1)


def seconds(x: Column) -> Column:
    """Whole seconds from 0 to a day."""
    return F.greatest(F.lit(0), F.least(F.lit(86_400), x.cast("long")))


def board_height(width: Column, ratio: Column) -> Column:
    """The height of a board of this width and proportion (height / width), within the bounds."""
    return F.greatest(F.lit(SIDE[0]), F.least(F.lit(SIDE[1]), half_up(width * ratio))).cast("int")


def board_size(preset: Column) -> tuple[Column, Column]:
    """(width, height) of a preset WxH; null for others."""
    ok = preset.rlike("^[0-9]+x[0-9]+$")
    return tuple(F.when(ok, F.split(preset, "x")[i].cast("int")) for i in (0, 1))


def page(place: Column, per_page: int) -> Column:
    """The page of the n-th item, from 0, n from 1."""
    return F.floor((place - 1) / per_page).cast("int")


def page_count(width: Column, height: Column, columns: int, rows: int) -> Column:
    return (F.ceil(width / F.lit(float(columns))) * F.ceil(height / F.lit(float(rows)))).cast("int")


def export_cell(longest: Column) -> Column:
    """Pixels of a cell in an exported picture, by the longest side."""
    return F.when(longest <= 60, 64).when(longest <= 120, 40).when(longest <= 240, 24).otherwise(12)


def legend(width: Column, count: Column, cell: int = 150) -> tuple[Column, Column]:
    """(columns, rows) of a legend of so many entries."""
    columns = F.greatest(F.lit(1), F.floor(width / cell)).cast("int")
    return columns, F.ceil(count / columns.cast("double")).cast("int")


def palette_key(brand: Column, count: Column) -> Column:
    return F.concat_ws("-", brand, count.cast("string"))


def palette_label(key: Column) -> Column:
    parts = F.split(key, "-")
    return F.concat(F.upper(parts[0]), F.lit(" "), parts[1], F.lit(" colours"))


def title(*names: Column, fallback: str = "untitled") -> Column:
    """The first name that is not empty, without its file extension."""
    tidy = [F.nullif(F.trim(F.regexp_replace(n, r"\.[A-Za-z0-9]+$", "")), F.lit("")) for n in names]
    return F.coalesce(*tidy, F.lit(fallback))


def timeout_ms(own: Column, common: Column) -> Column:
    """The first of two settings that is a number, within the bounds; a default without."""
    low, high, default = TIMEOUT_MS
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(own.try_cast("int"), common.try_cast("int"), F.lit(default))))


def finite(x: Column) -> Column:
    """The number, or 0 for what is none."""
    y = x.try_cast("double")
    return F.when(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))), y).otherwise(0.0)


def end_hint(mode: Column, end: Column) -> Column:
    """What to say about a session's end."""
    return F.when(end.isNull(), "no end").when(mode == "countup", F.concat(F.lit("until "), clock.clock(end))).otherwise(F.concat(F.lit("ends "), clock.clock(end)))


def main_text(status: Column, start: Column, end: Column, now: Column, pause_start: Column) -> Column:
    """A desk's clock: time used or left, over, or paused; it stands still while paused."""
    at = F.coalesce(pause_start, now)
    left = clock.seconds_between(at, end)
    used = clock.duration_clock(clock.seconds_between(start, at))
    return F.when(status == "empty", "--:--").when(end.isNull() | (status == "infinit"), used).when(left < 0, F.concat(F.lit("+"), clock.duration_clock(-left))).otherwise(clock.duration_clock(left))


def shift_clock(text: Column, minutes: Column) -> Column:
    """A time HH:MM moved by minutes, around midnight."""
    total = F.pmod(F.substring(text, 1, 2).cast("int") * 60 + F.substring(text, 4, 2).cast("int") + minutes, F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(total / 60), total % 60)


def pausable(status: Column, paused: Column) -> Column:
    return ~paused & status.isin("normal", "ending", "urgent", "infinit")


def safe_to_show(classes: Column, bounds: Mapping[str, float]) -> Column:
    """Whether no class of (class, probability) reaches its bound; those without a bound, and none at all, are safe."""
    reached = lambda c: sum((F.when((c["class"] == k) & (c["probability"] >= b), 1).otherwise(0) for k, b in bounds.items() if b), start=F.lit(0)) > 0
    return ~F.coalesce(F.exists(classes, reached), F.lit(False))


#: How an order number begins, and the signs it ends with.
ORDER_PREFIX, ORDER_SIGNS = "PB", "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def order_no(ts: Column, prefix: str = ORDER_PREFIX, alphabet: str = ORDER_SIGNS, seed: int | None = None) -> Column:
    """Prefix, month and day, and five random signs, with hyphens between."""
    signs = [F.substring(F.lit(alphabet), F.floor(F.rand(None if seed is None else seed + i) * len(alphabet)).cast("int") + 1, F.lit(1)) for i in range(5)]
    return F.concat(F.lit(f"{prefix}-"), F.date_format(ts, "MMdd"), F.lit("-"), *signs)


#: The longest text on a label; words of a session, and the category that they name.
LABEL_MOST = 80
CATEGORIES = ((("熨烫",), "熨烫服务"), (("香囊", "香薰", "彩绘"), "手作体验"))
OTHER_CATEGORY = "拼豆计时"


def label_text(text: Column, fallback: str = "") -> Column:
    """A text as it is printed: trimmed, without line breaks, at most so many signs."""
    from tesserae.functions.text import stripped

    return F.substring(F.replace(stripped(F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))), F.lit("\n"), F.lit(" ")), 1, LABEL_MOST)


def session_category(session: Column) -> Column:
    from tesserae.functions.text import has_any

    out = F
    for words, name in CATEGORIES:
        out = out.when(has_any(session, words), name)
    return out.otherwise(OTHER_CATEGORY)


def progress(saved: Column) -> tuple[Column, Column]:
    """(completed steps, elapsed milliseconds) of stored progress: a bare list, or an object with `completed` and `elapsedMs`; of anything else none."""
    listed = F.from_json(saved, "array<string>")
    full = F.from_json(saved, "completed array<string>, elapsedMs double")
    bare = F.startswith(F.ltrim(saved), F.lit("["))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.coalesce(F.when(bare, listed).otherwise(full["completed"]), none)), F.when(bare, 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(full["elapsedMs"], F.lit(0.0))))


def json_path(document: Column, path: str, fallback: str | None = None) -> Column:
    """What stands at a path such as settings.colours[0] of a JSON text, or the fallback."""
    return F.coalesce(F.get_json_object(document, f"$.{path}"), F.lit(fallback))
