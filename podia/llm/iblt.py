"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs, in SQL expressions alone.

A sketch has 3 sub-tables of cells; a paragraph's digest lies in one cell of
each. A cell holds the sum of signs, the XOR of the digests and the XOR of
their check values. The difference of two sketches holds just the digests that
one of the texts lacks. Peeling takes a digest out of each cell that holds a
single one, until no cell is left; if it stops before, the paragraphs are dealt
to as many tables as their number asks for, and a table that fails again is
built anew, twice as large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podia.llm.common import MAX_BROADCAST_IDS, materialise

#: A paragraph is a line; of a longer line each run of PARAGRAPH_WORDS words counts as one.
PARAGRAPH_WORDS = 8
#: Cells of a sub-table in the fingerprint and at the first attempt, and how often they are doubled.
CELLS, DOUBLINGS = 9, 3
#: Digests of both texts that are dealt to one table, on average.
PER_TABLE = 16
#: Rounds after which peeling gives up; a table of 3 * CELLS cells needs fewer.
ROUNDS = 24
#: Documents that one window sorts, and how many cuts of the ids a plan holds.
RUN_ROWS, MAX_CUTS = 1000, 65_536

_PARAGRAPH = rf"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+){{0,{PARAGRAPH_WORDS - 1}}}"


def paragraphs(text: str) -> str:
    """SQL: the distinct digests (the upper 63 bits of XXH64, so never negative) of a text's paragraphs."""
    pattern = _PARAGRAPH.replace("\\", "\\\\")
    return f"array_distinct(transform(regexp_extract_all({text}, '{pattern}', 0), p -> shiftrightunsigned(xxhash64(p), 1)))"


def _check(digest: str) -> str:
    return f"cast(shiftright(xxhash64({digest}, 7), 32) as int)"


def _entry(digest: str, sign: str, cells: int) -> str:
    """SQL: a digest with its cell in each sub-table, for tables of this size.

    Tables of the least size take the lower bits of the digest itself, as
    dealing goes by the upper ones; larger ones take those of a hash of their own.
    """
    bits = digest if cells == CELLS else f"xxhash64({digest}, {cells})"
    place = [f"cast(((shiftright({bits}, {15 * t}) & 32767) % {cells}) as int)" for t in range(3)]
    return f"named_struct('d', {digest}, 's', {sign}, 'p0', {place[0]}, 'p1', {place[1]}, 'p2', {place[2]}, 'h', {_check(digest)})"


_EMPTY = "named_struct('c', 0, 'k', 0L, 'h', 0)"
_ADD = "(s, x) -> named_struct('c', s.c + x.s, 'k', s.k ^ x.d, 'h', s.h ^ x.h)"
_TAKE = "(s, y) -> named_struct('c', s.c - y.s, 'k', s.k ^ y.d, 'h', s.h ^ y.h)"


def _three(of) -> str:
    """SQL: a struct of the three sub-tables t0, t1, t2, each of(t)."""
    return "named_struct(" + ", ".join(f"'t{t}', {of(t)}" for t in range(3)) + ")"


def entries(digests: str, sign: int, cells: int) -> str:
    return f"transform({digests}, d -> {_entry('d', str(sign), cells)})"


def table(these: str, cells: int) -> str:
    """SQL: the cells of a table that holds the entries."""
    tables = _three(lambda t: f"transform(sequence(0, {cells - 1}), j -> aggregate(filter(e0, x -> x.p{t} = j), {_EMPTY}, {_ADD}))")
    return f"transform(array({these}), e0 -> {tables})[0]"


def subtract(left: str, right: str) -> str:
    return _three(lambda t: f"zip_with({left}.t{t}, {right}.t{t}, (a, b) -> named_struct('c', a.c - b.c, 'k', a.k ^ b.k, 'h', a.h ^ b.h))")


#: What is gathered of the digests that peeling takes out, as (type, none, those of a round): how many, or d with its sign s.
COUNT = ("int", "0", "size(pure)")
DIGESTS = ("array<struct<d:bigint,s:int>>", "cast(array() as array<struct<d:bigint,s:int>>)", "transform(pure, y -> named_struct('d', y.d, 's', y.s))")


def _plus(kind: tuple, a: str, b: str) -> str:
    return f"{a} + {b}" if kind is COUNT else f"concat({a}, {b})"


def peel(table_of: str, cells: int, kind: tuple = COUNT) -> str:
    """SQL: how many digests peeling recovers from a table, or which; null if cells are left over.

    A round takes every digest that is alone in some cell out of all of its cells.
    """
    alone = lambda sign: f"array_distinct(transform(filter(every, x -> x.c = {sign} and x.h = {_check('x.k')}), x -> x.k))"
    pure = f"concat(transform({alone(1)}, d -> {_entry('d', '1', cells)}), transform({alone(-1)}, d -> {_entry('d', '-1', cells)}))"
    pure = f"transform(array(concat(st.t.t0, st.t.t1, st.t.t2)), every -> {pure})[0]"
    rest = _three(lambda t: f"transform(st.t.t{t}, (x, j) -> aggregate(filter(pure, y -> y.p{t} = j), x, {_TAKE}))")
    step = f"transform(array({pure}), pure -> if(size(pure) = 0, named_struct('t', st.t, 'n', st.n, 'go', false), named_struct('t', {rest}, 'n', {_plus(kind, 'st.n', kind[2])}, 'go', true)))[0]"
    left = "exists(concat(st.t.t0, st.t.t1, st.t.t2), x -> x.c <> 0 or x.k <> 0L or x.h <> 0)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('t', {table_of}, 'n', {kind[1]}, 'go', true), (st, i) -> if(st.go, {step}, st), st -> if({left}, cast(null as {kind[0]}), st.n))"


def _table_difference(ours: str, theirs: str, kind: tuple) -> str:
    """SQL: the differing digests of one table's share, or their number, by ever larger tables.

    Only if the largest fails too are the two lists compared themselves.
    """
    tries = []
    for k in range(DOUBLINGS + 1):
        cells = CELLS << k
        tries.append(peel(table(f"concat({entries(ours, 1, cells)}, {entries(theirs, -1, cells)})", cells), cells, kind))
    only = [(f"array_except({ours}, {theirs})", 1), (f"array_except({theirs}, {ours})", -1)]
    tries.append(_plus(kind, *[f"size({x})" if kind is COUNT else f"transform({x}, d -> named_struct('d', d, 's', {s}))" for x, s in only]))
    return f"coalesce({', '.join(tries)})"


def _dealt(above: str, low: str, span: str, ways: str, level: int, inner: str, kind: tuple) -> str:
    """SQL: the sum (or the lists together) of `inner` over the digests of `above` (a, b), dealt by ranges of equal width, `ways` of them.

    Each list is sorted together with the lower ends of all ranges but the
    first, and cut there.
    """
    s, g = f"s{level}", f"g{level}"
    marks = "transform(sequence(1, v.w - 1), i -> v.low + i * v.step)"
    sort = lambda side: f"if(v.w = 1, {above}.{side}, sort_array(concat({above}.{side}, {marks})))"
    bound = f"named_struct('w', {ways}, 'low', {low}, 'step', {span} div {ways})"
    sorted_ = f"transform(array({bound}), v -> named_struct('a', {sort('a')}, 'b', {sort('b')}, 'w', v.w, 'low', v.low, 'step', v.step))[0]"

    def part(side: str) -> str:
        at = lambda i: f"cast(array_position({s}.{side}, {s}.low + {i} * {s}.step) as int)"
        stop = f"if(i{level} = {s}.w - 1, size({s}.{side}) + 1, {at(f'(i{level} + 1)')})"
        return f"if({s}.w = 1, {s}.{side}, transform(array(if(i{level} = 0, 0, {at(f'i{level}')})), o -> slice({s}.{side}, o + 1, {stop} - o - 1))[0])"

    each = f"transform(array(named_struct('a', {part('a')}, 'b', {part('b')}, 'low', {s}.low + i{level} * {s}.step, 'step', {s}.step)), {g} -> {inner})[0]"
    return f"transform(array({sorted_}), {s} -> aggregate(sequence(0, {s}.w - 1), {kind[1]}, (n{level}, i{level}) -> {_plus(kind, f'n{level}', each)}))[0]"


def difference(ours: str, theirs: str, our_sketch: str, their_sketch: str, kind: tuple = COUNT) -> str:
    """SQL: the number of digests that only one of two texts has, or which they are, from their sketches, or from larger tables if they fail.

    For those the digests are dealt by ranges, to 64 tables at most at a time.
    """
    need = f"cast(greatest(1, ceil((size({ours}) + size({theirs})) / {PER_TABLE})) as int)"
    leaf = f"if(size(g0.a) + size(g0.b) = 0, {kind[1]}, {_table_difference('g0.a', 'g0.b', kind)})"
    inner = _dealt("g1", "g1.low", "g1.step", "t.w0", 0, leaf, kind)
    outer = _dealt("t", "0L", "9223372036854775807L", "t.w1", 1, inner, kind)
    ways = f"transform(array({need}), n -> named_struct('a', {ours}, 'b', {theirs}, 'w1', cast(ceil(n / 64) as int), 'w0', cast(ceil(n / ceil(n / 64)) as int)))[0]"
    larger = f"transform(array({ways}), t -> {outer})[0]"
    return f"coalesce({peel(subtract(our_sketch, their_sketch), CELLS, kind)}, {larger})"


def sketch(digests: str) -> str:
    return table(entries(digests, 1, CELLS), CELLS)


def as_text(sketch_of: str) -> str:
    """SQL: a sketch as text, for each sub-table the cells with count, digests, check values."""
    return f"cast({sketch_of} as string)"


def likeness(difference: str, ours: str, theirs: str) -> str:
    """SQL: twice the shared paragraphs in proportion to both texts' paragraphs; 1 for two texts without any."""
    both = f"(size({ours}) + size({theirs}))"
    return f"if({both} = 0, 1D, ({both} - {difference}) / cast({both} as double))"


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, run, ghost): every document, and in each run a ghost of the document that follows the run.

    Runs are ranges of ids with about RUN_ROWS documents, cut at approximate
    quantiles; beyond MAX_CUTS of these, each range is cut further into equal
    parts. Rows without an id are ranges of the text's hash, below all ids. In
    descending order the one after a run's last is the first of the run below,
    and after the very last the very first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = rows.agg(F.count("id").alias("n"), F.count("*").alias("all"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    ranges = min(MAX_CUTS, max(1, whole["n"] // RUN_ROWS))
    parts, nulls = max(1, -(-whole["n"] // (RUN_ROWS * ranges))) if ranges == MAX_CUTS else 1, (whole["all"] - whole["n"]) // RUN_ROWS + 1
    at = [i / ranges for i in range(1, ranges)]
    cuts = (rows.agg(F.percentile_approx("id", at, 100 * 1000)).first()[0] if at else None) or []
    bounds = sorted({*cuts, *([whole["lo"], whole["hi"] + 1] if whole["n"] else [0, 1])})
    # The last bound that is not above the id, by halving.
    halve = "(s, i) -> if(s.hi - s.lo <= 1, s, if(bounds[(s.lo + s.hi) div 2] <= id, named_struct('lo', (s.lo + s.hi) div 2, 'hi', s.hi), named_struct('lo', s.lo, 'hi', (s.lo + s.hi) div 2)))"
    halve = halve.replace("(s.lo + s.hi) div 2", "cast((s.lo + s.hi) div 2 as int)")
    share = "cast(id - bounds[s.lo] as double) / cast(bounds[s.lo + 1] - bounds[s.lo] as double)"
    found = f"aggregate(sequence(0, {len(bounds).bit_length()}), named_struct('lo', 0, 'hi', {len(bounds) - 1}), {halve}, s -> cast(s.lo as bigint) * {parts} + least({parts} - 1, cast(floor({share} * {parts}) as bigint)))"
    unnamed = f"least(-1, cast(floor(cast(tie as double) / 18446744073709551616D * {nulls} - {nulls} / 2) as bigint))"
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("bounds", F.lit(bounds).cast("array<bigint>"))
    rows = rows.withColumn("run", F.expr(f"if(id is null, {unnamed}, {found})").cast("long")).drop("bounds")
    first = rows.groupBy("run").agg(F.max(F.struct("id", "tie")).alias("m")).select("run", "m.id", "m.tie")
    first = materialise(first, "run-heads")
    order = Window.orderBy(F.col("run").asc())
    above = F.coalesce(F.lead("run").over(order), F.first("run").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = first.select(above.alias("to"), F.col("id").alias("head"), F.col("tie").alias("head_tie"))
    heads = F.broadcast(heads) if first.count() <= MAX_BROADCAST_IDS else heads
    ghosts = rows.join(heads, F.col("id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie"))).dropDuplicates(["to"])
    ghosts = ghosts.select("id", "text", F.col("to").alias("run"), "tie", F.lit(True).alias("ghost"))
    return rows.withColumn("ghost", F.lit(False)).select("id", "text", "run", "tie", "ghost").unionByName(ghosts)


def sketch_docs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `paragraphs` (distinct digests) and `sketch` (cells), for comparing versions of a text elsewhere.

    Columns of these names are replaced; the others stay. A null or empty text
    has no paragraphs and an empty sketch; repeated rows get equal sketches; an
    empty table stays empty.
    """
    text = f"coalesce(cast(`{text_col}` as string), '')"
    out = docs.withColumn("paragraphs", F.expr(paragraphs(text)))
    return out.withColumn("sketch", F.expr(sketch("paragraphs")))


def differing_paragraphs(versions: DataFrame, old_col: str = "old", new_col: str = "new") -> DataFrame:
    """versions with `gone` and `added`: the digests, in order, of the paragraphs that only the old and only the new text has.

    They are what peeling recovers from the difference of the two sketches, or
    of larger tables where it fails. Null counts as empty; columns of these
    names are replaced; repeated rows get equal answers; an empty table stays empty.
    """
    texts = [f"coalesce(cast(`{c}` as string), '')" for c in (old_col, new_col)]
    sides = versions.select(F.struct(*[F.col(c) for c in versions.columns if c not in ("gone", "added")]).alias("v"), *[F.expr(paragraphs(t)).alias(n) for t, n in zip(texts, "ab", strict=True)])
    sides = sides.withColumn("sketch_a", F.expr(sketch("a"))).withColumn("sketch_b", F.expr(sketch("b")))
    found = sides.select("v.*", F.expr(difference("a", "b", "sketch_a", "sketch_b", DIGESTS)).alias("__found"))
    of = lambda sign: F.array_sort(F.transform(F.filter("__found", lambda x: x["s"] == sign), lambda x: x["d"]))
    return found.withColumns({"gone": of(1), "added": of(-1)}).drop("__found")


def edited_text(text: Column, after: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many code points from the start of `after`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, the edited text's SHA-256, both fingerprints, near_edited and near_next.

    The next document is the one with the next smaller id (of equal ids, the
    one with the next smaller hash of the text), after the last the first. Texts are shuffled once,
    to runs of neighbouring ids; all else happens within a row.

    A null text counts as empty; null ids come last in descending order, as one
    run with the smallest ids. Equal texts have equal fingerprints. A single
    document is its own next one; an empty table gives an empty result; other
    columns of docs are ignored.
    """
    dealt = with_next(docs, id_col, text_col).repartition("run")
    own = dealt.withColumn("a", F.expr(paragraphs("text"))).withColumn("sketch_a", F.expr(sketch("a")))
    after = Window.partitionBy("run").orderBy("ghost", F.col("id").desc_nulls_last(), F.col("tie").desc())
    pairs = own.withColumns({"next_text": F.lead("text").over(after), "c": F.lead("a").over(after), "sketch_c": F.lead("sketch_a").over(after)}).filter("not ghost")
    pairs = pairs.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).withColumn("b", F.expr(paragraphs("edited")))
    pairs = pairs.withColumn("sketch_b", F.expr(sketch("b")))
    return pairs.select(
        F.col("id").alias(id_col),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(as_text("sketch_a")).alias("fingerprint"),
        F.expr(as_text("sketch_b")).alias("edited_fingerprint"),
        F.expr(likeness(difference("a", "b", "sketch_a", "sketch_b"), "a", "b")).alias("near_edited"),
        F.expr(likeness(difference("a", "c", "sketch_a", "sketch_c"), "a", "c")).alias("near_next"),
    )
