"""Secret scans with sliding-window entropy, in DataFrame functions (operator 8).

Fixed kinds are regular expressions.  Beyond them, every long run of key
characters is a candidate.  The characters that fixed kinds cover are taken
out of it, and words and short numbers between separators off both ends of
each part that stays (``docs/example/<key>`` leaves the key).  A window slides
over what is left: the count of each character is updated by the one that
enters and the one that leaves, and with the counts the window's Shannon
entropy.  A part whose best window reaches its character class's threshold is
a span, unless an allow-list pattern matches it.

Places come from the lengths of the texts between matches, summed by a window
over the matches of one row, so a text's cost grows with its length alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softcluster.llm.tables import written


@dataclass(frozen=True)
class Kind:
    """Matches of ``pattern`` whose group has ``least`` characters or more."""
    name: str
    pattern: str
    group: int
    least: int


KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = Kind("entropy", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)

#: A segment between separators that is a word, some words or a short number, and no part of a key's ends.
PLAIN = r"^([A-Z]?[a-z]{1,15}([A-Z][a-z]{2,15}){0,3}|[A-Z]{1,15}|[0-9]{0,10})$"
SEPARATOR = r"[^A-Za-z0-9]"

#: Least bits per character of a window, by the candidate's character class (the first that matches).
CLASSES = (("digits", r"^[0-9]+$", 3.2), ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 2.8), ("one_case", r"^([a-z]+|[A-Z]+)$", 3.8),
           ("letters", r"^[A-Za-z+/_=-]+$", 4.0), ("upper", r"^[A-Z0-9]+$", 3.4), ("base64", r"", 3.6))

#: Candidates that these match are no secrets: identifiers, alphabets and keys marked as examples.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)^(0123456789|1234567890|abcdefghijklmnopqrstuvwxyz|abcdef){1,8}$",
    r"EXAMPLE(KEY)?$",
)


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """Array of a text's matches: the characters before each, its own, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else found
    return F.when(F.size(found) > 0, F.transform(
        F.arrays_zip(found.alias("m"), values.alias("v"), F.split(text, kind.pattern, -1).alias("g")),
        lambda x: F.struct(F.lit(number).alias("kind"), F.char_length(x["g"]).alias("gap"),
                           F.char_length(x["m"]).alias("size"), (F.char_length(x["v"]) >= kind.least).alias("ok"), x["m"].alias("m"))))


def best_entropy(value: Column, width: int) -> Column:
    """The largest entropy, in bits per character, of the windows of ``width``
    characters of an ASCII string; of the whole string if it is shorter."""
    codes = F.transform(F.split(value, ""), F.ascii)

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def move(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda c, j: F.when(j == code, c + by).otherwise(c))

    def change(state: Column, code: Column, by: int) -> Column:
        c = F.get(state["counts"], code)
        return F.struct(move(state["counts"], code, by).alias("counts"),
                        (state["sum"] + term(c + by) - term(c)).alias("sum"), state["best"].alias("best"))

    def step(state: Column, i: Column, codes: Column) -> Column:
        full = F.when(i > width, change(state, F.get(codes, i - width - 1), -1)).otherwise(state)
        now = change(full, F.get(codes, i - 1), 1)
        n = F.least(i, F.lit(width)).cast("double")
        h = F.log2(n) - now["sum"] / n
        ready = (i >= width) | (i == F.size(codes))
        return F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"),
                        F.when(ready, F.greatest(now["best"], h)).otherwise(now["best"]).alias("best"))

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    # One-element array: the codes are then a variable, computed once.
    return F.get(F.transform(F.array(codes), lambda c: F.aggregate(
        F.sequence(F.lit(1), F.size(c)), start, lambda s, i: step(s, i, c), lambda s: s["best"])), F.lit(0))


def _uncovered(runs: DataFrame, covers: DataFrame, least: int) -> DataFrame:
    """row, at (start) and m of the stretches of runs (row, start, end, m;
    apart from each other), ``least`` characters or longer, that no span of
    covers touches.  The edges of both are swept in order, row by row."""
    def edge(df: DataFrame, at: str, run: int, cover: int, start: Column) -> DataFrame:
        return df.select("row", F.col(at).alias("at"), F.lit(run).alias("c"), F.lit(cover).alias("f"), start.cast("int").alias("run"))

    none = F.lit(None)
    edges = (edge(runs, "start", 1, 0, F.col("start")).unionAll(edge(runs, "end", -1, 0, none))
             .unionAll(edge(covers, "start", 0, 1, none)).unionAll(edge(covers, "end", 0, -1, none)))
    points = edges.groupBy("row", "at").agg(F.sum("c").alias("c"), F.sum("f").alias("f"), F.max("run").alias("run"))
    order = Window.partitionBy("row").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    free = points.select("row", "at", F.sum("c").over(upto).alias("c"), F.sum("f").over(upto).alias("f"), F.max("run").over(upto).alias("start"),
                         (F.lead("at").over(order) - F.col("at")).alias("size"))
    free = free.where((F.col("c") > 0) & (F.col("f") == 0) & (F.col("size") >= least))
    parts = free.groupBy("row", "start").agg(F.collect_list(F.struct("at", "size")).alias("parts"))
    cut = lambda x: F.struct(x["at"].alias("at"), F.substring(F.col("m"), x["at"] - F.col("start") + 1, x["size"]).alias("m"))
    return runs.join(parts, ["row", "start"]).select("row", F.explode(F.transform("parts", cut)).alias("x")).select("row", "x.*")


def _trimmed(parts: DataFrame, plain: str) -> DataFrame:
    """row, start, end and m of parts (row, at, m) without the plain segments at
    their ends; parts of nothing else are left out."""
    def taken(segments: Column, first: Column) -> Column:
        """Characters of the segments before the first one that is not plain, separators included."""
        return F.aggregate(F.slice(segments, F.lit(1), F.greatest(first - 1, F.lit(0))), F.lit(0), lambda n, x: n + F.char_length(x) + 1)

    cut = parts.withColumn("seg", F.split("m", SEPARATOR, -1)).withColumn("plain", F.transform("seg", lambda x: x.rlike(plain)))
    cut = cut.withColumns({"a": F.array_position("plain", F.lit(False)).cast("int"),
                           "b": F.array_position(F.reverse("plain"), F.lit(False)).cast("int")}).where(F.col("a") > 0)
    cut = cut.withColumns({"head": taken(F.col("seg"), F.col("a")), "tail": taken(F.reverse("seg"), F.col("b"))})
    size = F.char_length("m") - F.col("head") - F.col("tail")
    return cut.select("row", (F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.col("head") + size).alias("end"),
                      F.substring(F.col("m"), F.col("head") + 1, size).alias("m"))


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, width: int = 20,
         classes: tuple[tuple[str, str, float], ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED,
         plain: str = PLAIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: row (unique), doc_id, spans, and the columns of ``keep`` as k0, k1, ...

    spans: array of start, kind (number in ``kinds``, their count for entropy)
    and end, in that order; characters are code points, ends exclusive.  Null
    and empty texts have none (an empty array); repeated rows each give a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    all_kinds = (*kinds, CANDIDATE)
    rows = docs.select("doc_id", *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                       *[_matches(text, i, k).alias(f"m{i}") for i, k in enumerate(all_kinds)])
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,ok:boolean,m:string>>")
    lists = [F.coalesce(f"m{i}", none) for i in range(len(all_kinds))]
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[f"k{i}" for i in range(len(keep))],
                               *[x.alias(f"m{i}") for i, x in enumerate(lists)]), "secrets")
    each = None
    for i in range(len(all_kinds)):
        part = rows.where(F.size(f"m{i}") > 0).select("row", F.posexplode(f"m{i}").alias("pos", "x")).select("row", "pos", "x.*")
        each = part if each is None else each.unionAll(part)
    end = F.sum(F.col("gap") + F.col("size")).over(
        Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = each.withColumn("end", end).where("ok").select("row", (F.col("end") - F.col("size")).alias("start"), "kind", "end", "m")
    fixed = spans.where(F.col("kind") < len(kinds)).drop("m")

    runs = spans.where(F.col("kind") == len(kinds)).select("row", "start", "end", "m")
    likely = _trimmed(_uncovered(runs, fixed, CANDIDATE.least), plain).where(F.col("end") - F.col("start") >= CANDIDATE.least)
    for pattern in allowed:
        likely = likely.where(~F.col("m").rlike(pattern))
    least = F.coalesce(*[F.when(F.col("m").rlike(p), F.lit(bits)) for _, p, bits in classes])
    added = likely.where(best_entropy(F.col("m"), width) >= least).select("row", "start", F.lit(len(kinds)).alias("kind"), "end")
    per_row = (fixed.unionAll(added).groupBy("row")
               .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.drop(*[f"m{i}" for i in range(len(all_kinds))]).join(per_row, "row", "left").withColumn(
        "spans", F.coalesce("spans", empty))


def joined(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in (*kinds, CANDIDATE)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """docs with every span's text replaced by ``mask`` (overlapping spans by
    one), and n_chars, where docs has it, set to the new length."""
    columns = docs.columns
    found = scan(docs, keep=tuple(columns), **options)
    names = {c: f"k{i}" for i, c in enumerate(columns)}
    text = F.col(names["text"])
    # Ends of what earlier spans cover; a span that starts beyond leaves a gap.
    state = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask)))
            .otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at")),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    clean = F.when(F.size("spans") == 0, text).otherwise(state)
    out = {c: F.col(k) for c, k in names.items()} | {"text": clean}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.size("spans") == 0, F.col(names["n_chars"])).otherwise(
            F.char_length(clean)).cast(docs.schema["n_chars"].dataType)
    return found.select(*[out[c].alias(c) for c in columns])
