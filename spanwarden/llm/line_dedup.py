"""Line deduplication by a segment-partition edit join, in Spark expressions only.

Lines of at least ``MIN_CHARS`` code points are joined by edits; with ``short``, shorter lines that hold a
letter or digit take part as far as they are equal. Two lines link if at most so many edits lie between
them as ``LADDER`` allows for the shorter one. A line that may differ by t edits is cut into t + 1
segments: another one within the threshold holds a segment unchanged, near its place. So each line is
indexed by (number, hash) of its segments and probes, for each length it could link with, the
substrings that the multi-match-aware bounds allow (Li, Deng, Wang and Feng: Pass-Join, 2011), each
place once; a segment's length tells its line's. These keys, and one of the whole line, are small rows
that meet in one partially aggregated shuffle; only lines whose keys others share are looked at again.
Where more than ``CROWD`` lines share a segment, they are joined by it and a piece of the rest, cut in
the same way. Candidates are verified by banded edit distance.

``share`` (off unless asked for) lets long lines lie further apart: one edit for each ``share`` code
points. They meet by pieces sampled so that every such pair shares one.

A line goes if an equal line, or a line linked with it, stands earlier (smaller doc_id, then smaller hash
of the row, then earlier in the text). Lines are known by 64-bit hash and length, rows by a 64-bit hash
of doc_id and text.

Defined results: a null text has no lines and stays null; an empty text is one empty line, which stays;
a text that loses lines and is left with white space only is dropped from ``without_repeats`` (one that
had none to lose stays); rows without doc_id are later than all others; rows that share a doc_id are
documents of their own; rows equal in doc_id and text are one document, whose lines stay in each or go
from each; an empty table gives an empty one; lines of any length take part whole; extra columns pass
through, and helper columns avoid their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwarden.llm.common import cut, fresh, join_small, quoted, sifted

MIN_CHARS = 30
#: (least length, edits): how far two lines may lie apart, by the shorter one's length.
LADDER = ((0, 2),)
#: Code points of a sampled piece, where ``share`` is given.
GRAM = 20
#: What a shorter line has to hold to take part.
WORD = r"[\p{L}\p{N}]"
#: Lines that may share a segment and be paired by it and counts of characters alone; beyond the first number
#: counts of neighbouring characters are compared, too; beyond the second lines are joined by finer keys.
CROWD, CROWDS = 16, 1024
#: Characters whose counts are compared before lines are paired, and the number of classes of neighbouring ones.
COUNTED, NEIGHBOURS = "eanirtosdhluc ,1", 32
#: Keys (8 bytes) and rows of told lines (60 bytes) that are broadcast at most; beyond that both sides, without texts, are dealt out by salted key.
BROADCAST_KEYS, BROADCAST_LINES = 1_000_000, 100_000
#: Documents that lose lines, with the lines' places, broadcast at most.
BROADCAST_GONE = 10_000
#: What stands for the whole line among a line's probes.
WHOLE = -1

Ladder = Sequence[tuple[int, int]]


def edits_at(n: int, ladder: Ladder) -> int:
    return [t for least, t in ladder if max(n, 0) >= least][-1]


def _edits(n: str, ladder: Ladder) -> str:
    """SQL of the edits that a line of ``n`` code points may differ by."""
    return "case " + " ".join(f"when {n} >= {least} then {t}" for least, t in reversed(ladder)) + " end"


def _takes(line: Column, least: int, short: bool) -> Column:
    return (F.length(line) >= least) | line.rlike(WORD) if short else F.length(line) >= least


def _order(doc_id: Column) -> Column:
    """A document's place: rows without doc_id come last."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"))


def _row(docs: DataFrame, doc_id: str, text: str) -> Column:
    """A hash of doc_id and text; a null text isn't an empty one."""
    return F.xxhash64(F.col(quoted(doc_id)), F.col(quoted(text)).isNull(), F.col(quoted(text)))


def occurrences(docs: DataFrame, doc_id: str, text: str, least: int, short: bool = False) -> DataFrame:
    """(doc, row, at, line, h, n): each line that takes part."""
    rows = docs.select(_order(F.col(quoted(doc_id))).alias("doc"), _row(docs, doc_id, text).alias("row"), F.posexplode(F.split(F.col(quoted(text)), "\n", -1)).alias("at", "line"))
    return rows.filter(_takes(F.col("line"), least, short)).select("*", F.xxhash64("line").alias("h"), F.length("line").alias("n"))


def _moves(i: int, less: int, edits: int) -> range:
    """How far from its place segment i can stand in a line that is ``less`` code points longer."""
    return range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)


def _segment(length: str, i: str, edits: str) -> tuple[str, str]:
    """SQL of segment i's start (from 0) and length, in ``length`` code points that are cut into edits + 1."""
    q, r = f"(({length}) div ({edits} + 1))", f"(({length}) % ({edits} + 1))"
    return f"({i} * {q} + greatest(0, {i} - ({edits} + 1 - {r})))", f"({q} + if({i} >= {edits} + 1 - {r}, 1, 0))"


def _piece(start: str, size: str) -> str:
    return f"substring(line, cast({start} + 1 as int), cast({size} as int))"


def probes(n: int, ladder: Ladder, once: bool = True) -> list[tuple[int, int, int, int]]:
    """(how much shorter the other line is, segment, move, its edits) of every probe of a line of n code points.

    The probe of a line's own length without a move is its index entry. With ``once``, of probes for one
    segment number that read the same place one is left (the first: an index entry if it is among them).
    """
    top = max(t for _, t in ladder)
    each = ((less, edits_at(n - less, ladder)) for less in range(top + 1))
    out = [(less, i, move, t) for less, t in each if less <= t for i in range(t + 1) for move in sorted(_moves(i, less, t), key=abs)]
    if not once:
        return out
    read = {}
    for less, i, move, t in out:
        q, r = (n - less) // (t + 1), (n - less) % (t + 1)
        read.setdefault((i, t, i * q + max(0, i - (t + 1 - r)) + move, q + (i >= t + 1 - r)), (less, i, move, t))
    return list(read.values())


def _code(less: int, i: int, move: int, t: int) -> int:
    """One number for a probe, see ``_decoded``."""
    return ((less * 16 + i) * 64 + move + 32) * 16 + t


def _decoded(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.expr("code div 16384").alias("less"), F.expr("code div 1024 % 16").alias("i"), F.expr("code div 16 % 64 - 32").alias("move"), F.expr("code % 16").alias("t"))


def _codes(ladder: Ladder, once: bool, whole: bool) -> str:
    """SQL of the codes of a line's probes: an array that depends on n's rung, and its remainder there."""

    def of(n: int) -> str:
        return f"array({', '.join(str(c) for c in [WHOLE] * whole + [_code(*p) for p in probes(n, ladder, once)])})"

    top = max(t for _, t in ladder)
    out, least = [], 0
    # next to a rung the other line's edits may differ from the line's own
    for n in sorted({least + k for least, _ in ladder if least for k in range(top + 1)}):
        if n > least:
            out.append((n, least))
        out.append((n + 1, n))
        least = n + 1
    cases = [f"when n < {end} then {_by_remainder(start, end, ladder, of)}" for end, start in out]
    return f"case {' '.join(cases)} else {_by_remainder(least, least + 1000, ladder, of)} end" if cases else _by_remainder(1000, 2000, ladder, of)


def _by_remainder(start: int, end: int, ladder: Ladder, of) -> str:
    if end == start + 1:
        return of(start)
    parts = edits_at(end - 1, ladder) + 1
    at = end - 1 - (end - 1) % parts  # far from the rung before
    if at - parts < start:  # too few lengths to choose from: each by itself
        return "case " + " ".join(f"when n = {n} then {of(n)}" for n in range(start, end)) + " end"
    return f"case n % {parts} " + " ".join(f"when {r} then {of(at - parts + r)}" for r in range(parts)) + " end"


def keys(lines: DataFrame, ladder: Ladder, least: int = 0, once: bool = True, whole: bool = False) -> DataFrame:
    """The probes of every line (h, n, line, and more columns): adds code, less, i, move, t, own (index entries), key and u.

    Lines of fewer than ``least`` code points give only the key of the whole line, which ``whole`` asks for; it is odd.
    ``u`` is the line as UTF-16, whose substrings need no scan from its start; a line beyond that plane is cut as it is.
    """
    rows = lines.withColumn("u", F.encode("line", "UTF-16BE")).withColumn("line", F.when(F.octet_length("u") != 2 * F.col("n"), F.col("line")))
    codes = F.expr(f"case when n < {least} then array({WHOLE if whole else ''}) else {_codes(ladder, once, whole)} end")
    rows = _decoded(rows.select("*", F.explode(codes).alias("code")))
    start, size = _segment("n - less", "i", "t")
    piece = f"if(line is null, substring(u, cast(2 * ({start} + move) + 1 as int), cast(2 * {size} as int)), encode({_piece(f'{start} + move', size)}, 'UTF-16BE'))"
    rows = rows.withColumn("key", F.expr(f"if(code = {WHOLE}, xxhash64(h, n) | 1L, xxhash64(i, t, {piece}) & ~1L)"))
    return rows.withColumn("own", F.expr(f"code <> {WHOLE} and less = 0 and move = 0"))


def _finer(ladder: Ladder) -> list[tuple[int, bool, bool, int, int]]:
    """(code, own, after, u, du): the finer keys of each probe, and of each index entry.

    A shared segment i leaves at most i edits before it and t - i after it, in one of the pair's
    matches at least. So the longer part is cut into one segment more than it has edits, and one of
    these is shared too.
    """
    out = []
    for less, i, move, t in sorted({p for least, _ in ladder for k in range(max(t for _, t in ladder) + 1) for p in probes(least + k, ladder, False)}):
        after = 2 * i <= t
        left, at, more = (t - i, less - move, t - i) if after else (i, move, i)
        for own in (False, True) if less == 0 == move else (False,):
            out += [(_code(less, i, move, t), own, after, u, du) for u in range(left + 1) for du in ([0] if own else _moves(u, at, more))]
    return out


def _counts() -> list[Column]:
    """How often the line holds each character of COUNTED: f0, f1, ..."""
    return [(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c), F.lit("")))).alias(f"f{k}") for k, c in enumerate(COUNTED)]


def _neighbours() -> Column:
    """A string with a character for each two neighbouring ones of the line: the class that they hash to."""
    classes = f"transform(sequence(1, greatest(1, n - 1)), i -> char(65 + pmod(xxhash64(get(c, i - 1), get(c, i)), {NEIGHBOURS})))"
    return F.expr(f"element_at(transform(array(split(line, '')), c -> array_join({classes}, '')), 1)").alias("classes")


def _neighbour_counts() -> list[Column]:
    """How often each class stands in ``classes``: g0, g1, ..."""
    return [(F.length("classes") - F.length(F.replace("classes", F.lit(chr(65 + k)), F.lit("")))).alias(f"g{k}") for k in range(NEIGHBOURS)]


def _met(rows: DataFrame, ladder: Ladder) -> DataFrame:
    """(ha, hb), ha < hb: index entries with the probes of other lines that have their key (rows: h, n, key, own and counts).

    An edit moves the counts of characters by two at most and those of neighbours by four, so most pairs
    that lie further apart are refuted in the join.
    """
    more = [c for c in rows.columns if c[0] in "fg" and c[1:].isdigit()]
    a = rows.filter("own").select("key", F.col("h").alias("ha"), F.col("n").alias("na"), *[F.col(c).alias(f"{c}a") for c in more])
    b = rows.select("key", F.col("h").alias("hb"), F.col("n").alias("nb"), *[F.col(c).alias(f"{c}b") for c in more])
    may = f"a.key = b.key and nb - na between 0 and {_edits('na', ladder)} and ha <> hb"
    for kind, by in (("f", 2), ("g", 4)):
        if moved := " + ".join(f"abs({c}a - {c}b)" for c in more if c[0] == kind):
            may += f" and {moved} <= {by} * {_edits('na', ladder)}"
    return a.alias("a").join(b.alias("b"), F.expr(may)).select(F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb")).distinct()


def shared_keys(lines: DataFrame, ladder: Ladder, least: int, whole: bool = False) -> DataFrame:
    """(key): what two different lines have in common; with ``whole``, also the odd keys of lines that stand in two places."""
    rows = keys(lines, ladder, least, whole=whole)
    # the lowest bit is left out of comparisons
    x = F.expr(f"if(code = {WHOLE}, xxhash64(row, at), h)") if whole else F.col("h")
    sums = rows.select("key", x.alias("x")).groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return cut(sums.filter("lo <> hi").select("key"))


def members(lines: DataFrame, ladder: Ladder, least: int, shared: DataFrame) -> DataFrame:
    """(h, n, line, has array<struct<key, own>>, f0, f1, ...): the lines that have one of the keys, one row each.

    A few more keys and lines come along; ``candidates`` leaves out keys of one line alone.
    """
    rows = keys(lines, ladder, least)
    # there are as many rows as probes, with their lines' texts: they aren't dealt out
    met = sifted(rows.select("h", "n", "line", "u", "key", "own"), "key", shared, shared.count())
    # equal lines are one; no line has more keys than probes
    met = met.groupBy("h", "n").agg(F.any_value(F.coalesce("line", F.decode("u", "UTF-16BE"))).alias("line"), F.collect_set(F.struct("key", "own")).alias("has"))
    return cut(met.select("*", *_counts()))


def candidates(met: DataFrame, ladder: Ladder, crowd: int = CROWD, crowd_most: int = CROWDS) -> DataFrame:
    """(ha, hb), ha < hb: pairs of members' hashes that share a segment where the threshold allows it.

    Pairs that share a segment with more than ``crowd`` lines have more counts to agree in. A segment that
    more than ``crowd_most`` lines share is not joined by itself: its lines meet by finer keys, which take a
    piece before or after it as well.
    """
    counts = [f"f{k}" for k in range(len(COUNTED))]
    rows = met.select("h", "n", *counts, F.inline("has"))
    # a key without an index entry, or of one line alone, pairs nothing
    sums = rows.groupBy("key").agg(F.count("*").alias("c"), F.max("own").alias("own"), F.min("h").alias("lo"), F.max("h").alias("hi")).filter("own and lo <> hi")
    sums = cut(sums.select("key", (F.col("c") > crowd).alias("crowded"), (F.col("c") > crowd_most).alias("crowds")))
    n = sums.count()
    marked = join_small(rows, sums, ["key"], n, "inner", BROADCAST_KEYS)
    plain = _met(marked.filter("not crowded"), ladder)
    crowded, crowds = sums.filter("crowded and not crowds").select("key"), sums.filter("crowds").select("key")
    n_crowded, n_crowds = crowded.count(), crowds.count()
    if not n_crowded + n_crowds:
        return plain
    ids = cut(marked.filter("crowded").select("h").distinct())
    lines = sifted(met, "h", ids, ids.count()).select("h", "n", "line", "has", *counts, _neighbours())
    counts += [f"g{k}" for k in range(NEIGHBOURS)]
    lines = cut(cut(lines).select("*", *_neighbour_counts()).drop("classes"))
    some = join_small(lines.select("h", "n", *counts, F.inline("has")), crowded, ["key"], n_crowded, "inner", BROADCAST_KEYS)
    plain = plain.union(_met(some, ladder)).distinct()
    if not n_crowds:
        return plain
    # all probes of the lines that have such keys, again with their texts; what meets by a finer key of another one is a candidate, too
    lines = lines.select("h", "n", "line", *counts, F.col("line").alias("whole"))
    rest = sifted(keys(lines, ladder, once=False).select("h", "n", *counts, "key", "code", "own", "whole"), "key", crowds, n_crowds)
    table = ", ".join(str(x).lower() for x in _finer(ladder))
    spec = lines.sparkSession.sql(f"select * from values {table} as t(code, own, after, u, du)")  # a constant table
    both = rest.union(rest.filter("own").withColumn("own", F.lit(False)))
    fine = _decoded(both.join(F.broadcast(spec), ["code", "own"]).withColumnRenamed("whole", "line"))
    start, size = _segment("n - less", "i", "t")
    before, s = _segment(start, "u", "i")
    behind, z = _segment(f"(n - less - {start} - {size})", "u", "(t - i)")
    piece = f"if(after, {_piece(f'{start} + {size} + move + {behind} + du', z)}, {_piece(f'{before} + du', s)})"
    fine = fine.select("h", "n", *counts, "own", F.expr(f"xxhash64(key, after, u, {piece})").alias("key")).distinct()
    return plain.union(_met(fine, ladder)).distinct()


def texts_of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(h, n, line): one of the lines of each hash in ``ids``, and of a few others; equal lines are one."""
    found = sifted(lines.select("h", "n", "line"), "h", ids, ids.count())
    return found.groupBy("h", "n").agg(F.any_value("line").alias("line"))


def _allowed(n: str, ladder: Ladder, share: int | None) -> str:
    """SQL of the edits that two lines may lie apart, of which the shorter has ``n`` code points."""
    return f"greatest({_edits(n, ladder)}, {n} div {share})" if share else _edits(n, ladder)


def _sampled(share: int) -> str:
    """SQL of the hashes of the pieces of ``GRAM`` code points that are least in some window of a line.

    If t edits lie between two lines, t + 1 stretches of the shorter one stand in both, one of them at
    least as long as the mean. The window is what fits in it, so the stretch's least piece is sampled
    in both lines (winnowing: Schleimer, Wilkerson and Aiken, 2003).
    """
    stretch = f"ceil((n - 2 * (n div {share})) / (n div {share} + 1))"
    hashes = f"transform(regexp_extract_all(line, '(?s)(?=(.{{{GRAM}}}))', 1), g -> xxhash64(g))"
    window = f"cast(greatest(1, {stretch} - {GRAM - 1}) as int)"
    bind = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    least = "array_distinct(transform(sequence(0, greatest(0, size(a) - w)), i -> array_min(slice(a, i + 1, w))))"
    return bind("a", hashes, bind("w", window, least))


def long_candidates(lines: DataFrame, ladder: Ladder, share: int) -> DataFrame:
    """(ha, hb): pairs of different long lines that share a sampled piece, where ``share`` allows more edits than the ladder."""
    long = lines.filter(f"n div {share} > {_edits('n', ladder)}")
    # equal lines give equal keys: the maximum is any of them
    keyed = long.select("h", "n", F.expr(_sampled(share)).alias("keys")).groupBy("h", "n").agg(F.max("keys").alias("keys")).select("h", "n", F.explode("keys").alias("key"))
    a, b = keyed.select("key", F.col("h").alias("ha"), F.col("n").alias("na")), keyed.select("key", F.col("h").alias("hb"), F.col("n").alias("nb"))
    pairs = a.join(b, "key").filter(f"ha < hb and abs(nb - na) <= {_allowed('least(na, nb)', ladder, share)}")
    return pairs.select("ha", "hb").distinct()


def within(pairs: DataFrame, a: str, b: str, edits: int | str) -> DataFrame:
    """The pairs whose strings are at most ``edits`` (a number or SQL) apart.

    What both begin and end with is taken off first, found by halving steps: the banded distance scans a
    string from its start for each row, so what is left should be short.
    """
    steps = f"array({', '.join(str(1 << k) for k in range(16, -1, -1))})"
    bind = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    least = f"least(length({a}), length({b}))"
    head = f"aggregate({steps}, 0, (m, k) -> if(m + k <= {least} and substring({a}, m + 1, k) = substring({b}, m + 1, k), m + k, m))"
    tail = f"aggregate({steps}, 0, (m, k) -> if(m + k <= {least} - p and substring({a}, length({a}) - m - k + 1, k) = substring({b}, length({b}) - m - k + 1, k), m + k, m))"
    rest = lambda x: f"substring({x}, p + 1, length({x}) - p - q)"
    return pairs.filter(F.expr(bind("p", head, bind("q", tail, f"levenshtein({rest(a)}, {rest(b)}, cast({edits} as int)) >= 0"))))


def links(met: DataFrame, ladder: Ladder = LADDER, lines: DataFrame | None = None, share: int | None = None) -> DataFrame:
    """(ha, na, hb, nb): the pairs of different lines that link; with ``share`` also of the long ones among ``lines``."""
    pairs, texts = candidates(met, ladder), met.select("h", "n", "line")
    if share and lines is not None:
        pairs = cut(pairs.union(long_candidates(lines, ladder, share)).distinct())
        texts = cut(texts_of(lines, pairs.select(F.col("ha").alias("h")).union(pairs.select("hb")).distinct()))
    one, two = (texts.select(F.col("h").alias(f"h{s}"), F.col("n").alias(f"n{s}"), F.col("line").alias(f"l{s}")) for s in "ab")
    return within(pairs.join(one, "ha").join(two, "hb"), "la", "lb", _allowed("least(na, nb)", ladder, share)).select("ha", "na", "hb", "nb")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CHARS, ladder: Ladder = LADDER, short: bool = False, share: int | None = None) -> DataFrame:
    """(row, at, gone, near, links): the occurrences of lines that are repeated or linked; rows equal in doc_id and text give each theirs."""
    lines = occurrences(docs, doc_id, text, least, short)
    shared = shared_keys(lines.select("row", "at", "line", "h", "n"), ladder, least, whole=True)
    long = lines.filter(F.col("n") >= least)
    found = cut(links(members(long, ladder, least, shared.filter("key % 2 = 0")), ladder, lines=long, share=share))
    line = lambda h, n: F.expr(f"xxhash64({h}, {n}) | 1L")
    ends = found.select(line("ha", "na").alias("key"), line("hb", "nb").alias("other"))
    ends = ends.union(ends.select("other", "key"))
    told = cut(shared.filter("key % 2 <> 0").union(ends.select("key")).distinct())
    place = F.struct("doc", "row", "at").alias("place")
    # the few others are lines that stand once and link with none: they stay, and count for nothing
    hits = cut(sifted(lines.select(line("h", "n").alias("key"), place), "key", told, told.count()))
    first = cut(hits.groupBy("key").agg(F.min("place").alias("first")))
    # a line is near if a linked one's first place is before its own
    near = ends.join(first, "key").join(first.select(F.col("key").alias("other"), F.col("first").alias("theirs")), "other")
    near = near.groupBy("key").agg(F.max(F.col("theirs") < F.col("first")).alias("near"), F.count("*").alias("links"))
    told = cut(first.join(near, "key", "left").select("key", "first", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("links", F.lit(0)).cast("long").alias("links")))
    hits = join_small(hits, told, ["key"], told.count(), "inner", BROADCAST_LINES)
    return hits.select("place.row", "place.at", (F.col("near") | (F.col("first") != F.col("place"))).alias("gone"), "near", "links")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: what a lambda calls from outside is worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _left(text: str, at: str) -> Column:
    """What is left of a text without its lines at the places ``at``; null where no line is left."""
    some = lambda lines, stay: F.when(F.size(stay) > 0, F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    stays = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    kept = _bound(F.split(F.col(quoted(text)), "\n", -1), lambda lines: _bound(stays(lines), lambda stay: some(lines, stay)))
    return F.when(F.coalesce(F.size(at), F.lit(0)) <= 0, F.col(quoted(text))).otherwise(kept)


def _n_lines(text: str) -> Column:
    breaks = F.octet_length(quoted(text)) - F.octet_length(F.replace(F.col(quoted(text)), F.lit("\n"), F.lit("")))
    return F.coalesce(breaks + 1, F.lit(0)).cast("long")


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CHARS, ladder: Ladder = LADDER, short: bool = False, share: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_near, n_links): per document the lines that go, and its lines' links.

    n_removed is counted in the texts that are left, which ``without_repeats`` gives, too; n_near is how many of
    these lines stand after a line they link with.
    """
    hits = repeats(docs, doc_id, text, least, ladder, short, share)
    # equal rows have each been counted for the other too
    each = lambda c, to: F.expr(f"{c} div (n div size(places))").alias(to)
    sums = hits.groupBy("row").agg(F.collect_set(F.when(F.col("gone"), F.col("at"))).alias("at"), F.collect_set("at").alias("places"), F.count("*").alias("n"), F.count_if("near").alias("near"), F.sum("links").alias("links"))
    sums = cut(sums.filter("size(at) > 0 or links > 0").select("row", "at", each("near", "near"), each("links", "links")))
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"), _row(docs, doc_id, text).alias("row"))
    # equal rows would take one salt
    rows = join_small(rows, sums, ["row"], sums.count(), "left", BROADCAST_GONE, salts=1)
    rows = rows.select("doc_id", "text", _left("text", "at").alias("left"), *[F.coalesce(c, F.lit(0)).cast("long").alias(f"n_{c}") for c in ("near", "links")])
    return rows.select("doc_id", _n_lines("text").alias("n_lines"), (_n_lines("text") - _n_lines("left")).alias("n_removed"), "n_near", "n_links")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CHARS, ladder: Ladder = LADDER, short: bool = False, share: int | None = None) -> DataFrame:
    """The documents without the lines that go, with their own columns."""
    hits = repeats(docs, doc_id, text, least, ladder, short, share)
    key, at, out = (fresh(c, docs.columns) for c in ("_row", "_gone", "_text"))
    # no longer than the text has lines
    gone = cut(hits.filter("gone").groupBy(F.col("row").alias(key)).agg(F.collect_set("at").alias(at)))
    rows = join_small(docs.withColumn(key, _row(docs, doc_id, text)), gone, [key], gone.count(), "left", BROADCAST_GONE)
    rows = rows.withColumn(out, _left(text, at))
    rows = rows.filter(F.col(at).isNull() | F.col(out).rlike(r"\S"))
    return rows.select(*[F.col(out).alias(c) if c == text else F.col(quoted(c)) for c in docs.columns])
