"""Token sequences as column expressions: markers, moves and their rewriting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.coords import angular_points, delta_tokens, is_coordinate, parse, render, subtract

#: Markers of token sequences, by their use.
CORE = {"BOS": "<BOS>", "EOS": "<EOS>", "UNK": "<UNK_LEN>", "PAD": "<PAD>", "SRC_END": "<SRC_END>"}
SOURCE = {"DRIVER": "<DRIVER>", "LOAD": "<LOAD>"}
TREE = {"PUSH": "<PUSH>", "POP": "<POP>", "BRANCH": "[BRANCH]", "END": "[END]"}
OVERLAP = {"START": "<OVERLAP_START>", "END": "<OVERLAP_END>", "SEP": "<OVERLAP_SEP>", "DRIVER": "<OVERLAP_DRIVER>", "LOAD": "<OVERLAP_LOAD>"}
CONNECTED = {"START": "<CONNECTED_START>", "END": "<CONNECTED_END>", "SEP": "<CONNECTED_SEP>", "DRIVER": "<CONNECTED_DRIVER>", "LOAD": "<CONNECTED_LOAD>"}


def special_tokens(overlap: bool = False, connected: bool = False) -> list[str]:
    """All markers; those of neighbours only where they are used."""
    groups = [CORE, SOURCE, TREE] + [OVERLAP] * overlap + [CONNECTED] * connected
    return [t for g in groups for t in g.values()]


def check_options(decimal: bool, concatenate: bool, segment: bool) -> None:
    """Raises where rewritings contradict each other."""
    if decimal and concatenate:
        raise ValueError("decimal decomposition and concatenation exclude each other")
    if concatenate and segment:
        raise ValueError("concatenation and segmentation exclude each other")


def split_words(text: Column) -> Column:
    """Words of a text between white space; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def segment(tokens: Column) -> Column:
    """Cuts tokens that hold several moves into these; other characters of such a token are lost."""
    parts = lambda t: F.regexp_extract_all(t, F.lit("([RLUDTB][0-9]+)"), 1)
    return F.flatten(F.transform(tokens, lambda t: F.when(F.size(parts(t)) > 1, parts(t)).otherwise(F.array(t))))


def decompose(tokens: Column) -> Column:
    """Cuts in-layer moves into a token for each decimal place that is not zero: ``R2200`` gives ``R2000 R200``. Moves up to 10 stay."""

    def places(t: Column) -> Column:
        digits = F.substring(t, 2, 40).try_cast("decimal(38,0)").cast("string")
        split = F.split(digits, "")
        kept = F.transform(split, lambda c, i: F.when(c != "0", F.concat(F.substring(t, 1, 1), F.rpad(c, F.length(digits) - i, "0"))))
        return F.filter(kept, lambda x: x.isNotNull())

    large = lambda t: t.rlike(r"^[RLUD]\d+$") & (F.substring(t, 2, 40).try_cast("decimal(38,0)") > 10)
    return F.flatten(F.transform(tokens, lambda t: F.when(large(t), places(t)).otherwise(F.array(t))))


def concatenate(tokens: Column) -> Column:
    """Joins neighbouring in-layer moves into one token."""
    flat = lambda t: F.coalesce(t.rlike(r"^[RLUDrlud]\d+$"), F.lit(False))
    # a token that goes on with a run is marked, runs are then joined as text and cut apart again
    marked = F.transform(tokens, lambda t, i: F.when((i > 0) & flat(t) & flat(F.get(tokens, i - 1)), t).otherwise(F.concat(F.lit("\x00"), t)))
    return F.filter(F.split(F.array_join(marked, ""), "\x00"), lambda t: t != "")


def remove_markers(text: Column, markers: Sequence[str], gap: str = " ") -> Column:
    """Replaces markers as substrings, in order, and collapses white space."""
    for m in markers:
        text = F.replace(text, F.lit(m), F.lit(gap))
    return F.array_join(split_words(text), " ")


def rewrite(tokens: Column, decimal: bool = False, concat: bool = False, seg: bool = False, remove: Sequence[str] = ()) -> Column:
    """The rewriting chain over an array of tokens: decimal places after cutting, or joining, or cutting; then removal of tokens."""
    check_options(decimal, concat, seg)
    if decimal:
        tokens = decompose(segment(tokens))
    elif concat:
        tokens = concatenate(tokens)
    elif seg:
        tokens = segment(tokens)
    return F.filter(tokens, lambda t: ~t.isin(*remove)) if remove else tokens


def driver_tokens(driver: Column, marker: str = SOURCE["DRIVER"]) -> Column:
    """The marker and the moves from the origin to the driver; nothing for a driver that is no coordinate."""
    return F.when(is_coordinate(driver), F.concat(F.array(F.lit(marker)), delta_tokens(parse(driver)))).otherwise(F.array().cast("array<string>"))


def load_tokens(driver: Column, loads: Column, marker: str = SOURCE["LOAD"]) -> Column:
    """For each load by its angle around the driver the marker and the moves from the driver. Nothing without a driver."""
    base = parse(driver)
    moves = F.flatten(F.transform(angular_points(driver, loads), lambda p: F.concat(F.array(F.lit(marker)), delta_tokens(subtract(p, base)))))
    return F.when(is_coordinate(driver) & loads.isNotNull(), moves).otherwise(F.array().cast("array<string>"))


def neighbour_tokens(info: Column, names: dict[str, str], top: int = 5) -> Column:
    """Block of the first ``top`` neighbours, each with its driver and its loads relative to that; nothing for null or none."""
    one = lambda n: F.concat(driver_tokens(n["driver"], names["DRIVER"]), load_tokens(n["driver"], n["loads"], names["LOAD"]))
    items = F.transform(F.slice(info, 1, top), lambda n, i: F.concat(F.when(i > 0, F.array(F.lit(names["SEP"]))).otherwise(F.array().cast("array<string>")), one(n)))
    block = F.concat(F.array(F.lit(names["START"])), F.flatten(items), F.array(F.lit(names["END"])))
    return F.when(F.size(info) > 0, block).otherwise(F.array().cast("array<string>"))


def source_tokens(driver: Column, loads: Column, overlap: Column | None = None, connected: Column | None = None, top: int = 5) -> Column:
    """The source sentence: start, driver, loads, optional neighbour blocks, end."""
    parts = [F.array(F.lit(CORE["BOS"])), driver_tokens(driver), load_tokens(driver, loads)]
    if overlap is not None:
        parts.append(neighbour_tokens(overlap, OVERLAP, top))
    if connected is not None:
        parts.append(neighbour_tokens(connected, CONNECTED, top))
    return F.concat(*parts, F.array(F.lit(CORE["SRC_END"])))


def tree_marker(t: Column) -> Column:
    """Marker of a move sequence for a marker of a coordinate tree; other tokens stay."""
    return F.when(t == TREE["BRANCH"], TREE["PUSH"]).when(t == TREE["END"], TREE["POP"]).otherwise(t)


def training_text(source: Column, target: Column) -> Column:
    return F.concat_ws(" ", source, target)


def variant_alias(algorithm: Column, size: Column) -> Column:
    """``name-16K`` of an algorithm and a vocabulary size, sizes under a thousand in full; the decimal word-level algorithm has no size."""
    shown = F.when(size >= 1000, F.concat(F.floor(size / 1000).cast("string"), F.lit("K"))).otherwise(size.cast("string"))
    return F.when(algorithm == "DecimalWordLevel", algorithm).otherwise(F.concat(algorithm, F.lit("-"), shown))


def base_of(alias: Column) -> Column:
    return F.substring_index(alias, "-", 1)


def variant_of(alias: Column) -> Column:
    """What follows the first ``-``; empty without one."""
    return F.when(F.instr(alias, "-") > 0, F.regexp_replace(alias, "^[^-]*-", "")).otherwise("")


def group_label(token: Column, six: bool = True) -> Column:
    """Label of a move by its letter, ``U*`` or with ``six=False`` by axis, ``U-D``; anything else is ``SPECIAL``."""
    letter = F.substring(token, 1, 1)
    if six:
        return F.when(letter.isin(*"UDLRTB"), F.concat(letter, F.lit("*"))).otherwise("SPECIAL")
    return F.when(letter.isin("U", "D"), "U-D").when(letter.isin("L", "R"), "L-R").when(letter.isin("T", "B"), "T-B").otherwise("SPECIAL")


def seconds(time: Column) -> Column:
    """Seconds of ``H:MM:SS.S``; null if it has not three numbers."""
    part = lambda i: F.get(F.split(F.trim(time), ":"), F.lit(i)).try_cast("double")
    return F.when(F.size(F.split(time, ":")) == 3, part(0) * 3600 + part(1) * 60 + part(2))


def formatted(value: Column, places: int = 2) -> Column:
    """A number with fixed places, ``-`` for null and NaN."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), "-").otherwise(F.format_string(f"%.{places}f", value.cast("double")))


#: Fixed value: the instruction of a prompt.
INSTRUCTION = "Generate the 'Routing' solution based on the provided 'Driver' and 'Loads'."


def sft_prompt(driver: Column, loads: Column) -> Column:
    """Instruction, driver and loads joined by ``;``, with bare commas."""
    text = F.concat(F.lit(INSTRUCTION + "\nDriver: "), driver, F.lit("\nLoads: "), F.array_join(loads, ";"))
    return F.replace(text, F.lit(", "), F.lit(","))


def sft_completion(tree: Column) -> Column:
    return compact(F.array_join(tree, ""))


def compact(text: Column) -> Column:
    """A coordinate text with bare commas and ``>`` and ``<`` for the branch markers."""
    for old, new in ((", ", ","), (TREE["BRANCH"], ">"), (TREE["END"], "<")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def restore(text: Column) -> Column:
    """The inverse of :func:`compact`."""
    text = F.replace(F.replace(text, F.lit(">"), F.lit(TREE["BRANCH"])), F.lit("<"), F.lit(TREE["END"]))
    return F.regexp_replace(text, r"\((-?\d+),(-?\d+),(-?\d+)\)", r"($1, $2, $3)")


def cut_tail(text: Column) -> Column:
    """A text up to its last closing bracket; unchanged without one."""
    return F.when(F.instr(text, ")") > 0, F.regexp_extract(text, r"(?s)^(.*\))", 1)).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def pure(text: Column) -> Column:
    """The stripped text if it holds only digits, commas, brackets, branch marks and white space; else empty. A minus sign fails."""
    text = strip(F.coalesce(text, F.lit("")))
    return F.when(text.rlike(r"^[0-9,()<>\s]*$"), text).otherwise("")


def complete(text: Column) -> Column:
    """The text if every coordinate in it is written as numbers are, without leading zeros or ``-0``; else empty. Passes without coordinates."""
    text = F.coalesce(text, F.lit(""))
    points = F.regexp_extract_all(text, F.lit(r"(\(-?\d+,\s*-?\d+,\s*-?\d+\))"), 1)
    return F.when(F.exists(points, lambda p: p.rlike(r"[(,\s](-?0\d|-0[,)])")), "").otherwise(text)


def usable(text: Column) -> Column:
    """The text if it passes :func:`pure` and :func:`complete`, and both agree and are not empty."""
    a, b = pure(text), complete(text)
    return F.when((a != "") & (a == strip(b)), a).otherwise("")


def rectilinear(a: Column, b: Column) -> Column:
    """True if two points differ on at most one axis."""
    return sum(((a[n] != b[n]).cast("int") for n in "ym"), (a["x"] != b["x"]).cast("int")) <= 1


def chain_steps_valid(points: Column) -> Column:
    """True if every step of a chain of points moves on exactly one axis."""
    step = lambda a, b: sum(((a[n] != b[n]).cast("int") for n in "ym"), (a["x"] != b["x"]).cast("int")) == 1
    return F.forall(F.sequence(F.lit(1), F.size(points) - 1), lambda i: step(F.get(points, i - 1), F.get(points, i))) | (F.size(points) < 2)


def rebased(points: Column) -> Column:
    """Coordinates relative to the first one, as strings."""
    return F.transform(points, lambda p: render(subtract(p, F.get(points, F.lit(0)))))
