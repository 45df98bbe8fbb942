"""Personal data by weak supervision, in DataFrame and SQL expressions alone.

1. Base matchers find e-mail addresses, IPv4 addresses, payment cards and international phone numbers.
   Wider shapes add candidates: opaque hexadecimal secrets, national phone numbers, social security numbers
   and long digit groups. A candidate that overlaps a base span is dropped.
2. Labelers vote on every candidate: +1 personal, -1 not, 0 no opinion. One judges the strict shape, two look
   words and prefixes up in gazetteers, three look at the context and make-up of the span.
3. Expectation-maximisation estimates each labeler's reliability and each vote pattern's probability.
   It needs only how often each pattern occurs: 3^6 rows at most, whatever the corpus.
4. A logistic span classifier on shape and context features is fitted to those probabilities, again on counts
   of feature patterns, and decides which candidates join the base spans. Base spans always stay.

Very long texts don't take quadratic time: a run of characters is entered only at its start or where the match
before ended, repeated groups are possessive, offsets are running sums by doubling steps, overlaps
are found by running maxima over sorted spans, and the text around spans is read from a text cut into blocks.

Defined cases: null and empty texts have no spans; of wider candidates that overlap the earlier kind of PATTERNS stays; very long
texts are searched whole; repeated rows are handled row by row; an empty table
fits the prior and returns no rows; all columns of the caller's are kept, whatever their names, but for _base and _cand, which
are replaced. Offsets count code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, running

BASE = ("email", "ip", "card", "phone")
#: kind -> Java pattern. Runs are entered at their start or at the end of the match before (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9+])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
}
#: What a text must hold for a pattern to be worth trying.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
#: Words whose presence shortly before a span speaks for personal data, or against it.
WORDS_FOR = "token|secret|key|password|passwd|pwd|bearer|auth|tel|phone|call|fax|mobile|contact|mail|email|card|visa|mastercard|account|acct|ssn|social|user|ip|host|client|address"
WORDS_AGAINST = "order|invoice|isbn|issn|version|ver|build|page|figure|table|section|serial|sku|item"
TOP_DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|eu"
EM_STEPS = 20
FIT_STEPS = 60
#: Weight of the prior of a labeler's reliability, as a share of all candidates.
PRIOR = 0.1


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPAN = "array<struct<start:int,end:int,m:string>>"


def _spans(kind: str) -> str:
    """array<struct<start, end, m>> of the pattern's matches in column _t."""
    p = _lit(PATTERNS[kind])
    # Ends of the matches, from the parts between them; each part is as long as a match and the gap before it.
    with_gaps = f"zip_with(slice(split(_t, {p}, -1), 1, size(_m)), _m, (a, m) -> length(a) + length(m))".replace("_m", "g.m")
    ends = running("g.w", "size(g.w)", "x + p")
    made = (
        f"transform(array(struct(regexp_extract_all(_t, {p}, 0) AS m)), g -> if(size(g.m) = 0, cast(array() AS {_SPAN}), "
        f"transform(array(struct(g.m AS m, {with_gaps} AS w)), g -> zip_with({ends}, g.m, (e, m) -> struct(e - length(m) AS start, e AS end, m AS m)))[0]))[0]"
    )
    has = f"contains(_t, '{NEEDS[kind]}')" if kind in NEEDS else "_digit"
    return f"if({has}, {made}, cast(array() AS {_SPAN}))"


def _apart(spans: str, others: str) -> str:
    """The spans (ascending by start) that overlap none of the others, in time n log n.

    All are sorted by start; a span overlaps another if one that starts no later ends behind its start, or
    the next one starts before its end.
    """
    both = (
        f"array_sort(concat(transform({spans}, x -> struct(x.start AS start, 1 AS own, x.end AS end, x AS x)), "
        f"transform({others}, x -> struct(x.start AS start, 0 AS own, x.end AS end, cast(NULL AS struct<start:int,end:int,m:string>) AS x))))"
    )
    reach = running("transform(g, x -> if(x.own = 0, x.end, -1))", "size(g)", "greatest(x, p)")
    # The next start is running too, from the back.
    nexts = f"reverse({running('transform(reverse(g), x -> if(x.own = 0, x.start, 2147483647))', 'size(g)', 'least(x, p)')})"
    kept = f"filter(transform(g, (x, i) -> if(x.own = 1 AND h.a[i] <= x.start AND h.b[i] >= x.end, x.x, NULL)), x -> x IS NOT NULL)"
    return (
        f"if(size({spans}) = 0 OR size({others}) = 0, {spans}, "
        f"transform(array({both}), g -> transform(array(struct({reach} AS a, {nexts} AS b)), h -> {kept})[0])[0])"
    )


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    return (
        f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1, cast(substring({digits}, -i, 1) AS int), "
        f"element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + cast(substring({digits}, -i, 1) AS int)))) % 10 = 0"
    )


KEEP = {
    "email": "true",
    "ip": r"x.m rlike '^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(\\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$'",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "secret": "x.m rlike '[0-9]'",
    "local_phone": "true",
    "ssn": "true",
    "number": "true",
}

#: Labelers over a candidate c(kind, start, end, m, l, r): l and r are the 30 and 2 characters beside it.
LABELERS = {
    "shape": f"""CASE c.kind WHEN 'secret' THEN if(length(c.m) IN (32, 40, 64), 1, 0)
      WHEN 'ssn' THEN if(c.m rlike '^(?!000|666|9..)...-(?!00)..-(?!0000)....$', 1, -1)
      WHEN 'number' THEN if({_luhn('c.m')}, 1, -1) ELSE 1 END""",
    "words": rf"""CASE WHEN lower(c.l) rlike '(?<![a-z])({WORDS_FOR})[^a-z]*$' THEN 1
      WHEN lower(c.l) rlike '(?<![a-z])({WORDS_AGAINST})[^a-z]*$' THEN -1 ELSE 0 END""",
    "prefixes": rf"""CASE c.kind WHEN 'email' THEN if(lower(c.m) rlike '\\.({TOP_DOMAINS})$', 1, 0)
      WHEN 'ip' THEN if(c.m rlike '^(0|255)\\.', -1, 1)
      WHEN 'card' THEN if(c.m rlike '^(4|5[1-5]|2[2-7]|3[47]|6)', 1, 0) WHEN 'number' THEN if(c.m rlike '^(4|5[1-5]|2[2-7]|3[47]|6)', 0, -1)
      WHEN 'local_phone' THEN if(regexp_replace(c.m, '[^0-9]', '') rlike '^.11', -1, 1) ELSE 0 END""",
    "assigned": r"""CASE WHEN c.l rlike '[:=]\\s*["\']?$' THEN 1 WHEN c.l rlike '[#$/\\\\]$' THEN -1 ELSE 0 END""",
    "bounds": r"""CASE WHEN c.l rlike '\\p{L}$' OR c.r rlike '^\\p{L}' THEN -1 ELSE 1 END""",
    "variety": "CASE WHEN size(array_distinct(split(regexp_replace(c.m, '[^0-9A-Fa-f]', ''), ''))) >= 5 THEN 1 ELSE -1 END",
}
#: Prior reliability: P(+1 | personal, voted) and P(+1 | not personal, voted).
PRIORS = {"shape": (0.95, 0.05), "words": (0.9, 0.2), "prefixes": (0.8, 0.4), "assigned": (0.8, 0.3), "bounds": (0.9, 0.6), "variety": (0.9, 0.6)}

#: Features of the span classifier, 0 or 1.
FEATURES = {
    "one": "true",
    "base": "c.base",
    "secret": "c.kind = 'secret'",
    "local_phone": "c.kind = 'local_phone'",
    "ssn": "c.kind = 'ssn'",
    "number": "c.kind = 'number'",
    "named": f"({LABELERS['words']}) = 1",
    "unlike": f"({LABELERS['words']}) = -1",
    "assigned": f"({LABELERS['assigned']}) = 1",
    "quoted": r"""c.l rlike '["\']$' AND c.r rlike '^["\']'""",
    "joined": f"({LABELERS['bounds']}) = -1",
    "strict": f"({LABELERS['shape']}) = 1",
}


#: Code points of a block.
BLOCK = 1024


def blocks_of(text: str) -> str:
    """A text cut into blocks of BLOCK code points, in linear time."""
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def cut_at(blocks: str, start: str, length: str) -> str:
    """substring(text, start + 1, length) from the text's blocks; length at most BLOCK."""
    at = f"cast(({start}) DIV {BLOCK} AS int)"
    return f"substring(concat(coalesce(get({blocks}, {at}), ''), coalesce(get({blocks}, {at} + 1), '')), ({start}) - {at} * {BLOCK} + 1, {length})"


def around(base: str) -> str:
    """A span x with up to 30 characters to its left and 2 to its right."""
    left, right = cut_at("_blocks", "greatest(x.start - 30, 0)", "least(30, x.start)"), cut_at("_blocks", "x.end", "2")
    return f"struct({base} AS base, x.kind AS kind, x.start AS start, x.end AS end, x.m AS m, {left} AS l, {right} AS r)"


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus _base (array of kind, start, end) and _cand (array of base, kind, start, end, votes, features).

    Every text is searched whole.
    """
    given = [c for c in docs.columns if c not in ("_base", "_cand")]
    # The caller's columns travel in one struct, so that no name of theirs meets the working columns'.
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("_given"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"))
    # Stages of their own, so that the expressions read columns and aren't repeated.
    df = df.withColumn("_digit", F.expr("_t rlike '[0-9]'"))
    for kind in PATTERNS:
        df = df.withColumn(f"_{kind}", F.expr(f"filter({_spans(kind)}, x -> {KEEP[kind]})"))
    named = lambda kind: f"transform(_{kind}, x -> struct('{kind}' AS kind, x.start AS start, x.end AS end, x.m AS m))"
    df = df.withColumn("_base", F.expr(f"concat({', '.join(named(k) for k in BASE)})"))
    extra = [k for k in PATTERNS if k not in BASE]
    # A wider span overlaps no base span, and none of an earlier kind that doesn't either.
    for i, kind in enumerate(extra):
        df = df.withColumn(f"_{kind}", F.expr(_apart(f"_{kind}", "_base")))
        df = df.withColumn(f"_free_{kind}", F.expr(_apart(f"_{kind}", "concat(" + ", ".join(f"_{k}" for k in extra[:i]) + ")")) if i else F.col(f"_{kind}"))
    df = df.withColumn("_extra", F.expr(f"concat({', '.join(named(k).replace('_' + k + ',', '_free_' + k + ',', 1) for k in extra)})"))
    # Code points are found by walking a text, so long ones are cut into blocks of which a span's surroundings touch two at most.
    df = df.withColumn("_blocks", F.expr(f"if(size(_base) + size(_extra) = 0, cast(array() AS array<string>), {blocks_of('_t')})"))
    df = df.withColumn("_around", F.expr(f"concat(transform(_base, x -> {around('true')}), transform(_extra, x -> {around('false')}))"))
    votes = ", ".join(f"cast({v} AS int)" for v in LABELERS.values())
    features = ", ".join(f"cast({v} AS int)" for v in FEATURES.values())
    df = df.withColumn("_cand", F.expr(f"transform(_around, c -> struct(c.base AS base, c.kind AS kind, c.start AS start, c.end AS end, array({votes}) AS votes, array({features}) AS features))"))
    df = df.withColumn("_base", F.expr("transform(_base, x -> struct(x.kind AS kind, x.start AS start, x.end AS end))"))
    return df.select(*[F.col("_given")[c].alias(c) for c in given], "_base", "_cand")


def fit(cands: DataFrame) -> dict[str, list[float]]:
    """Reliabilities by expectation-maximisation, then the classifier's weights; both over counts of patterns."""
    n_lab, n_feat = len(LABELERS), len(FEATURES)
    # explode would have the optimizer push a test of the whole expression of _cand below it.
    counts = cands.select(F.explode_outer("_cand").alias("c")).filter("c IS NOT NULL").groupBy("c.votes", "c.features").agg(F.count("*").cast("double").alias("n"))
    rows = counts.agg(F.coalesce(F.collect_list(F.struct("votes", "features", "n")), F.array()).alias("p"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"))
    prior_a = "array(" + ", ".join(f"{a}D" for a, _ in PRIORS.values()) + ")"
    prior_b = "array(" + ", ".join(f"{b}D" for _, b in PRIORS.values()) + ")"

    def log_of(which: str) -> str:
        return f"aggregate(sequence(0, {n_lab - 1}), 0D, (t, j) -> t + CASE x.votes[j] WHEN 1 THEN ln({which}[j]) WHEN -1 THEN ln(1 - {which}[j]) ELSE 0D END)"

    posterior = f"1 / (1 + exp(greatest(-60D, least(60D, ln(1 - s.pi) - ln(s.pi) + {log_of('s.b')} - {log_of('s.a')}))))"

    def rate(of: str, prior: str) -> str:
        up = f"aggregate(s.q, 0D, (t, x) -> t + if(x.votes[j] = 1, x.n * {of}, 0D))"
        all_ = f"aggregate(s.q, 0D, (t, x) -> t + if(x.votes[j] <> 0, x.n * {of}, 0D))"
        return f"transform(sequence(0, {n_lab - 1}), j -> ({up} + {prior}[j] * w) / ({all_} + w))"

    rows = rows.withColumn("w", F.expr(f"1 + {PRIOR} * total"))
    # A step: probabilities of the patterns, then the rates that follow from them.
    e_step = f"struct(s.pi AS pi, s.a AS a, s.b AS b, transform(p, x -> struct(x.votes AS votes, x.n AS n, {posterior} AS q)) AS q)"
    m_step = (
        f"struct((aggregate(s.q, 0D, (t, x) -> t + x.n * x.q) + 0.5D * w) / (total + w) AS pi, {rate('x.q', prior_a)} AS a, {rate('(1 - x.q)', prior_b)} AS b, s.q AS q)"
    )
    start = f"struct(0.5D AS pi, {prior_a} AS a, {prior_b} AS b, cast(array() AS array<struct<votes:array<int>,n:double,q:double>>) AS q)"
    em = f"aggregate(sequence(1, {2 * EM_STEPS + 1}), {start}, (s, i) -> if(i % 2 = 1, {e_step}, {m_step}))"
    rows = rows.withColumn("em", F.expr(em))
    rows = rows.withColumn("d", F.expr("zip_with(p, em.q, (x, y) -> struct(x.features AS f, x.n AS n, y.q AS q))"))
    dot = f"aggregate(sequence(0, {n_feat - 1}), 0D, (t, j) -> t + wt[j] * x.f[j])"
    error = f"x.n * (1 / (1 + exp(-greatest(-60D, least(60D, {dot})))) - x.q)"
    step = (
        f"transform(array(transform(d, x -> struct(x.f AS f, {error} AS e))), g -> "
        f"transform(sequence(0, {n_feat - 1}), k -> wt[k] - 2D * (aggregate(g, 0D, (t, x) -> t + x.e * x.f[k]) / greatest(total, 1D) + 0.001D * wt[k])))[0]"
    )
    rows = rows.withColumn("wt", F.expr(f"aggregate(sequence(1, {FIT_STEPS}), array_repeat(0D, {n_feat}), (wt, i) -> {step})"))
    got = rows.select("wt", "em.pi", "em.a", "em.b").first()
    return {"weights": list(got["wt"]), "prior": [got["pi"]], "hit": list(got["a"]), "false": list(got["b"])}


def accepted(model: dict[str, list[float]]) -> Column:
    """Array (kind, start, end) of the base spans and the candidates that the classifier takes."""
    score = " + ".join(f"{w!r}D * c.features[{i}]" for i, w in enumerate(model["weights"]))
    return F.expr(f"transform(filter(_cand, c -> c.base OR ({score}) >= 0D), c -> struct(c.kind AS kind, c.start AS start, c.end AS end))")


def _ordered(col: str) -> str:
    kinds = "array(" + ", ".join(f"'{k}'" for k in PATTERNS) + ")"
    sorted_ = f"array_sort(transform({col}, x -> struct(cast(array_position({kinds}, x.kind) AS int) AS o, x.start AS start, x.end AS end, x.kind AS kind)))"
    return f"array_join(transform({sorted_}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def digest(df: DataFrame) -> DataFrame:
    """df with _base and _all -> counts, base_sha256 and spans."""
    counts = [F.expr(f"cast(size(filter(_base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(F.expr(_ordered("_base")), 256).alias("base_sha256"), F.expr(_ordered("_all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every accepted span of the text replaced by [KIND]; overlapping spans become one mark, the first's.

    The caller's columns are kept, whatever their names.
    """
    names = docs.columns
    at = names.index(text_col)
    # Under names of our own, for a caller may have columns called _base and _cand.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{at}"
    # Written once, for the fit and the redaction read it each.
    found = materialize(candidates(plain, text).drop("_base"), "candidates")
    model = fit(found.select("_cand"))
    df = found.withColumn("_a", accepted(model))
    df = df.withColumn("_s", F.expr("array_sort(transform(_a, x -> struct(x.start AS start, x.end AS end, x.kind AS kind)))"))
    # A span begins a mark unless one before it reaches beyond its start; a mark ends where the furthest of its spans does.
    df = df.withColumn("_r", F.expr(running("transform(_s, x -> x.end)", "size(_s)", "greatest(x, p)")))
    df = df.withColumn("_first", F.expr("filter(transform(_s, (x, i) -> if(i = 0 OR coalesce(get(_r, i - 1), 0) <= x.start, struct(x.start AS start, x.kind AS kind, i AS i), NULL)), x -> x IS NOT NULL)"))
    df = df.withColumn("_marks", F.expr("transform(_first, (x, n) -> struct(x.start AS start, x.kind AS kind, get(_r, if(n + 1 < size(_first), get(_first, n + 1).i, size(_s)) - 1) AS end))"))
    # What lies between marks is cut from blocks, piece by piece; a piece runs over whole blocks in its middle.
    df = df.withColumn("_b", F.expr(f"if(size(_marks) = 0, cast(array() AS array<string>), {blocks_of(text)})"))
    piece = lambda a, b: (
        f"if(({b}) - ({a}) <= {BLOCK}, {cut_at('_b', a, f'({b}) - ({a})')}, "
        f"concat(substring(get(_b, cast(({a}) DIV {BLOCK} AS int)), pmod({a}, {BLOCK}) + 1), "
        f"array_join(slice(_b, cast(({a}) DIV {BLOCK} AS int) + 2, cast(({b}) DIV {BLOCK} AS int) - cast(({a}) DIV {BLOCK} AS int) - 1), ''), "
        f"substring(coalesce(get(_b, cast(({b}) DIV {BLOCK} AS int)), ''), 1, pmod({b}, {BLOCK}))))"
    )
    before = piece("if(n = 0, 0, get(_marks, n - 1).end)", "x.start")
    tail = piece("get(_marks, size(_marks) - 1).end", f"length({text})")
    masked = f"concat(array_join(transform(_marks, (x, n) -> concat({before}, '[', upper(x.kind), ']')), ''), {tail})"
    df = df.withColumn("_out", F.expr(f"if(size(_marks) = 0, {text}, {masked})"))
    return df.select(*[F.col("_out" if i == at else f"c{i}").alias(n) for i, n in enumerate(names)])
