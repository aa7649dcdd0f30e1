"""Secret scans: multipart credential linking by an interval join inside scopes. DataFrame functions only."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgraph.checkpoints import cut
from heatgraph.llm.names import free, quoted

# The strong kinds, as (kind, pattern, measured group, least length of it). The runs of access and hex have
# their least length in the pattern: a shorter run holds no match of its own, so the matches are the same, and the words
# full of a to f don't become matches that are thrown away.
_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
STRONG = (
    ("assign", rf"(?:{_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", r"[0-9a-f]{24,}", 0, 0),
)
# Weak kinds as (kind, pattern, role): reported only together with a part of another role. Runs are bounded, so that no
# pattern goes over a long text more than a fixed number of times.
WEAK = (
    ("user", r"\b(?:[Uu]ser(?:name)?|[Ll]ogin|[Cc]lient_?[Ii]d|[Aa]ccount(?:_?[Ii]d)?|[Aa]ccess_?[Kk]ey(?:_?[Ii]d)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]+", "identifier"),
    ("phrase", r"\b(?:[Pp]wd|[Pp]ass|[Pp]assphrase|[Kk]ey|[Aa]uth|[Cc]redential|[Pp]rivate_?[Kk]ey)[\"']?\x20*[:=]\x20*[\"']?[^ \t\r\n\"']+", "secret"),
    ("endpoint", r"\b(?:[a-z][a-z0-9+.-]{1,15}://[^ \t\r\n\"'<>]+|[Hh]ost(?:name)?[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:-]+)", "endpoint"),
    ("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", "identifier"),
    ("address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b", "endpoint"),
)
# A word boundary in these patterns tells ASCII letters, digits and _ from all else; this is how Java's patterns say so.
_BEGINS, _ENDS = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
KINDS = [k for k, *_ in STRONG] + [k for k, *_ in WEAK]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: r for k, _, r in WEAK}
#: What a text must contain for a kind to be in it (one of these): looking for a few bytes is cheaper than a pattern.
_NEEDS = {"assign": "=:", "access": ["AKIA"], "user": "=:", "phrase": "=:", "endpoint": ["://", "ost"], "email": "@", "address": "."}
_SPANS = "array<struct<start:int,kind:int,end:int>>"  # sorts by start, then kind
_NONE = f"cast(array() as {_SPANS})"
_BREAK = r"\n(?:[ \t\r]*\n)+"
_BLOCK = 128
#: Code points of the pieces in which a long text is copied.
_PIECE = 4096


# Expressions over a text are written as SQL: one call builds them, where columns would take thousands.


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """Evaluates ``value`` once, for all places where ``body`` has ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _before(xs: str, fold: str) -> str:
    """The fold (an expression over {0} and {1}) of 0 and all earlier elements, for each element.

    Two levels keep it near linear for very long arrays.
    """
    folded = lambda part: f"aggregate({part}, 0, (a, n) -> {fold.format('a', 'n')})"
    own = f"transform(sequence(0, cast(floor((size(xs) - 1) / {_BLOCK}) as int)), b -> {folded(f'slice(xs, b * {_BLOCK} + 1, {_BLOCK})')})"
    starts = f"transform(own, (o, i) -> {folded('slice(own, 1, i)')})"
    each = f"transform(xs, (o, i) -> {fold.format(f'get(starts, cast(floor(i / {_BLOCK}) as int))', folded(f'slice(xs, i - i % {_BLOCK} + 1, i % {_BLOCK})'))})"
    return f"if(size({xs}) > 0, {_let('xs', xs, _let('own', own, _let('starts', starts, each)))}, cast(array() as array<int>))"


def _found(text: str, kind: str, pattern: str, group: int = 0, least: int = 0) -> str:
    """Leftmost non-overlapping matches as sorted spans, in code points, end exclusive.

    Matches alternate with the pieces between them, so sums of their lengths are the offsets. A text without a match is
    searched once, or not at all if it lacks what any match contains. Kinds that aren't in KINDS have the number -1.
    """
    if pattern.startswith(r"\b"):
        pattern = _BEGINS + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + _ENDS
    p, number = _text(pattern), KINDS.index(kind) if kind in KINDS else -1
    lengths = lambda g: f"transform(regexp_extract_all({text}, {p}, {g}), m -> length(m))"
    gaps = f"transform(split({text}, {p}, -1), m -> length(m))"
    at = _before("zip_with(slice(f.gap, 1, size(f.len)), f.len, (g, n) -> g + n)", "{0} + {1}")
    begins = f"zip_with({at}, slice(f.gap, 1, size(f.len)), (q, g) -> q + g)"
    rows = f"zip_with({begins}, zip_with(f.len, f.own, (n, o) -> named_struct('len', n, 'own', o)), (s, q) -> named_struct('start', s, 'len', q.len, 'own', q.own))"
    spans = f"transform(filter({rows}, r -> r.own >= {least}), r -> named_struct('start', r.start, 'kind', {number}, 'end', r.start + r.len))"
    here = " or ".join(f"contains({text}, {_text(x)})" for x in _NEEDS.get(kind, [""]))
    parts = f"named_struct('gap', {gaps}, 'len', {lengths(0)}, 'own', {lengths(group)})"
    return f"if(({here}) and rlike({text}, {p}), {_let('f', parts, spans)}, {_NONE})"


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _scoped(texts: DataFrame, reach: int) -> DataFrame:
    """``key, start, kind, end, role, lo, hi`` of the parts of ``texts(key, parts, breaks)``.

    The scope from lo to hi goes ``reach`` code points to each side, up to the nearest blank line.
    """
    at = Window.partitionBy("key").orderBy("start")
    rows = texts.select("key", F.explode(F.concat("parts", "breaks")).alias("x")).select("key", "x.*")
    stop = F.col("kind") < 0
    rows = rows.withColumns({
        "low": F.max(F.when(stop, F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, 0)),
        "high": F.min(F.when(stop, F.col("start"))).over(at.rowsBetween(0, Window.unboundedFollowing)),
    })
    roles = F.array(*(F.lit(ROLE[k]) for k in KINDS))
    lo = F.greatest(F.col("start") - reach, F.coalesce("low", F.lit(0)))
    hi = F.least(F.col("end") + reach, F.coalesce("high", F.col("end") + reach))
    return rows.filter(~stop).select("key", "start", "kind", "end", F.get(roles, F.col("kind")).alias("role"), lo.alias("lo"), hi.alias("hi"))


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """Weak parts of ``parts(key, start, end, kind, role, lo, hi)`` with a complementary part in their scope.

    An interval join: parts meet in buckets of ``reach`` code points of one text, and a partner must touch the stretch
    from lo to hi, however far it goes beyond. An identifier or an endpoint needs a secret; a secret needs an identifier
    or an endpoint. A partner is in every bucket it touches; spans of a kind don't overlap, so a text has about one row
    for each part and each bucket, a bucket holds at most ``reach`` parts of each kind and one from before, and no text
    makes more than a fixed number of partners for one part; the semi join keeps one row for each part.
    """
    weak = parts.filter(F.col("kind") >= len(STRONG))
    weak = weak.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / reach), F.floor(F.col("hi") / reach))))
    other = parts.select(F.col("key").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"), (F.col("role") == "secret").alias("x2"), F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))).alias("b2"))
    near = (F.col("key") == F.col("k2")) & (F.col("bucket") == F.col("b2")) & ((F.col("role") == "secret") != F.col("x2"))
    touches = (F.col("s2") <= F.col("hi")) & (F.col("e2") >= F.col("lo"))
    return weak.join(other, near & touches, "left_semi").select("key", "start", "end", "kind").distinct()


def _scanned(docs: DataFrame, keep: list[str], text: str, reach: int, out: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the spans of its texts in ``out``.

    Every text is searched once: what is kept goes to the shared checkpoint folder together with the spans, and only
    spans of texts with complementary parts are shuffled and joined.
    """
    found, key, links = (free([*docs.columns, out], n) for n in ("__found", "__key", "__links"))
    t = f"coalesce({quoted(text)}, '')"
    weak = lambda side: f"concat({', '.join(_found(t, k, p) for k, p, r in WEAK if (r == 'secret') == side)})"
    secret = f"array({', '.join(str(ROLE[k] == 'secret').lower() for k in KINDS)})"
    strong = f"concat({', '.join(_found(t, *k) for k in STRONG)})"
    # weak parts matter, and are looked for, only where a complement can be
    others = f"if(exists(concat(x.strong, x.phrase), p -> get({secret}, p.kind)), {weak(False)}, {_NONE})"
    has = lambda side: f"exists(y.every, p -> {'' if side else 'not '}get({secret}, p.kind))"
    some = f"if(size(y.every) > size(y.strong) and {has(True)} and {has(False)}, named_struct('key', sha2({t}, 256), 'parts', y.every, 'breaks', {_found(t, 'break', _BREAK)}), null)"
    made = _let("x", f"named_struct('strong', {strong}, 'phrase', {weak(True)})", _let("y", f"named_struct('strong', x.strong, 'every', concat(x.strong, x.phrase, {others}))", f"named_struct('strong', y.strong, 'text', {some})"))
    work = cut(docs.select(*[F.col(quoted(c)) for c in keep], F.expr(made).alias(found)))
    texts = work.filter(F.col(f"{found}.text").isNotNull()).groupBy(F.col(f"{found}.text.key").alias("key"))
    texts = texts.agg(F.first(f"{found}.text.parts").alias("parts"), F.first(f"{found}.text.breaks").alias("breaks"))
    linked = _linked(_scoped(texts, reach), reach).groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias(links))
    # only rows that may have links take part in the join; the others pass by it
    some = work.filter(F.col(f"{found}.text").isNotNull()).withColumn(key, F.col(f"{found}.text.key")).join(linked, key, "left").drop(key)
    rest = work.filter(F.col(f"{found}.text").isNull()).withColumn(links, F.lit(None).cast(_SPANS))
    spans = F.array_sort(F.concat(F.col(f"{found}.strong"), F.coalesce(F.col(links), F.expr(_NONE))))
    return some.unionByName(rest).withColumn(out, spans).select(*[F.col(quoted(c)) for c in keep], out)


def scan_secrets(docs: DataFrame, text: str = "text", reach: int = 200) -> DataFrame:
    """``docs`` with ``secret_spans``, an array of (start, kind as its number in KINDS, end), sorted.

    Strong kinds are found by their patterns alone. Weak kinds (user, phrase, endpoint, email, address) are reported only
    when a part of a complementary role lies in the same scope: at most ``reach`` code points away and in the same
    paragraph, that is with no blank line in between.

    Rows are kept one for one, repeated rows and clashing column names included; a column named ``secret_spans`` is
    replaced. A null or empty text has no spans. Equal texts have equal spans, so linking works on distinct texts, by
    their digest: copies meet before the join. Texts without complementary parts never reach a shuffle.
    """
    return _scanned(docs, [c for c in docs.columns if c.lower() != "secret_spans"], text, reach, "secret_spans")


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]", reach: int = 200) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; spans that touch or overlap share one mark.

    All other columns and rows stay as they are, whatever their names; null and empty texts are unchanged. A long text is
    copied in pieces, so the work grows with its length and its spans, not with their product.
    """
    spans = free(docs.columns, "__spans")
    found = _scanned(docs, docs.columns, text, reach, spans)
    raw, x = quoted(text), quoted(spans)
    # a span opens a marked stretch if it begins beyond all ends before it
    ends = f"transform({x}, p -> p.end)"
    rows = f"zip_with({x}, {_before(ends, 'greatest({0}, {1})')}, (p, e) -> named_struct('x', p, 'reached', e))"
    opens = f"filter({rows}, (p, i) -> i = 0 or p.x.start > p.reached)"
    merged = _let("r", opens, f"named_struct('start', transform(r, p -> p.x.start), 'end', concat(transform(slice(r, 2, size(r)), p -> p.reached), array(array_max({ends}))))")
    low = f"greatest(a - i * {_PIECE}, 0)"
    part = f"transform(sequence(cast(floor(a / {_PIECE}) as int), cast(floor((b - 1) / {_PIECE}) as int)), i -> substring(get(pieces, i), {low} + 1, least(b - i * {_PIECE}, {_PIECE}) - {low}))"
    between = f"zip_with(concat(array(0), m.end), concat(m.start, array(length({raw}))), (a, b) -> if(b > a, array_join({part}, ''), ''))"
    pieces = f"regexp_extract_all({raw}, '(?s).{{1,{_PIECE}}}', 0)"
    clean = f"if(size({x}) > 0, {_let('m', merged, _let('pieces', pieces, f'array_join({between}, {_text(mark)})'))}, {raw})"
    return found.withColumn(text, F.expr(clean)).select(*[F.col(quoted(c)) for c in docs.columns])


def secret_report(docs: DataFrame, reach: int = 200) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: counts of the strong kinds, their digest, and all spans."""
    found = _scanned(docs, ["doc_id"], "text", reach, "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda x: x["kind"] < len(STRONG))
    return found.select("doc_id", *(count(k) for k, *_ in STRONG), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))
