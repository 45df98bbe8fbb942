"""Text kernels as Spark SQL fragments: spans, lines, token estimates, stable JSON, token sets."""

from __future__ import annotations

from . import fixed

SPAN = "struct<start:int,end:int,value:string>"
FINDING = "struct<type:string,start:int,end:int,sensitivity:string,category:string>"


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rx(pattern: str) -> str:
    """A pattern as a literal for Java, with Python's meaning of classes and line ends."""
    return lit(fixed.JAVA + pattern)


def empty(of: str) -> str:
    return f"cast(array() AS array<{of}>)"


def running(array: str, size: str, step: str) -> str:
    """Running values of an array by log2(size) doubling steps. step: of a value x and the running value p before it."""
    shift = "cast(shiftleft(1, r) AS int)"
    once = f"transform(s, (x, i) -> if(i < {shift}, x, {step.replace('p', f'get(s, i - {shift})')}))"
    return f"if({size} < 2, {array}, aggregate(sequence(0, cast(ceil(log2({size})) AS int) - 1), {array}, (s, r) -> {once}))"


def spans(text: str, pattern: str) -> str:
    """array<SPAN> of a pattern's matches, in code points: running sums of the parts between matches and the matches."""
    p = rx(pattern)
    widths = f"zip_with(slice(split({text}, {p}, -1), 1, size(g.m)), g.m, (a, m) -> length(a) + length(m))"
    return (
        f"transform(array(struct(regexp_extract_all({text}, {p}, 0) AS m)), g -> if(size(g.m) = 0, {empty(SPAN)}, transform(array(struct(g.m AS m, {widths} AS w)), "
        f"g -> zip_with({running('g.w', 'size(g.w)', 'x + p')}, g.m, (e, m) -> struct(e - length(m) AS start, e AS end, m AS value)))[0]))[0]"
    )


#: Code points of a block.
BLOCK = 1024


def blocks(text: str) -> str:
    """A text cut into blocks of BLOCK code points: a place in a text is found by walking it, in a block within bounds."""
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def piece(blocks_: str, start: str, end: str) -> str:
    """The text from start to end, out of its blocks."""
    a, b = f"cast(({start}) DIV {BLOCK} AS int)", f"cast(({end}) DIV {BLOCK} AS int)"
    block = lambda i: f"coalesce(get({blocks_}, {i}), '')"
    return (
        f"if({a} = {b}, substring({block(a)}, ({start}) - {a} * {BLOCK} + 1, ({end}) - ({start})), concat(substring({block(a)}, ({start}) - {a} * {BLOCK} + 1), "
        f"array_join(slice({blocks_}, {a} + 2, {b} - {a} - 1), ''), substring({block(b)}, 1, ({end}) - {b} * {BLOCK})))"
    )


def meeting(spans_: str, others: str, kept: bool, of: str) -> str:
    """The spans, ascending by start, that overlap one of the others (kept), or none of them, in time n log n. of: the spans' type.

    All are sorted by start: a span overlaps another if one that starts no later ends behind its start, or the next
    one starts before its end.
    """
    both = (
        f"array_sort(concat(transform({spans_}, x -> struct(x.start AS start, 1 AS own, x.end AS end, x AS x)), "
        f"transform({others}, x -> struct(x.start AS start, 0 AS own, x.end AS end, cast(NULL AS {of}) AS x))))"
    )
    reach = running("transform(g, x -> if(x.own = 0, x.end, -1))", "size(g)", "greatest(x, p)")
    nexts = f"reverse({running('transform(reverse(g), x -> if(x.own = 0, x.start, 2147483647))', 'size(g)', 'least(x, p)')})"
    touches = "(h.a[i] > x.start OR h.b[i] < x.end)"
    found = f"filter(transform(g, (x, i) -> if(x.own = 1 AND {touches if kept else 'NOT ' + touches}, x.x, NULL)), x -> x IS NOT NULL)"
    none = empty(of) if kept else spans_
    return f"if(size({spans_}) = 0 OR size({others}) = 0, {none}, transform(array({both}), g -> transform(array(struct({reach} AS a, {nexts} AS b)), h -> {found})[0])[0])"


def clusters(spans_: str, touching: bool) -> str:
    """Spans sorted by start and end, parted into runs that overlap (touching: or meet) one after the other."""
    reach = running("transform(g, x -> x.end)", "size(g)", "greatest(x, p)")
    starts = f"filter(transform(g, (x, i) -> if(i = 0 OR h[i - 1] {'<' if touching else '<='} x.start, i, NULL)), i -> i IS NOT NULL)"
    cut = "transform(k, (i, n) -> slice(g, i + 1, if(n + 1 < size(k), get(k, n + 1), size(g)) - i))"
    return f"transform(array(array_sort({spans_})), g -> transform(array({reach}), h -> transform(array({starts}), k -> {cut})[0])[0])[0]"


def line_number(text: str, at: str) -> str:
    """1 and the number of \\n before an offset."""
    return f"1 + length(substring({text}, 1, {at})) - length(replace(substring({text}, 1, {at}), '\\n', ''))"


def lines_before(blocks_: str) -> str:
    """Of each block how many \\n stand before it."""
    own = f"transform({blocks_}, b -> length(b) - length(replace(b, '\\n', '')))"
    return f"transform(array({own}), g -> zip_with({running('g', 'size(g)', 'x + p')}, g, (e, n) -> e - n))[0]"


def line_in_blocks(blocks_: str, before: str, at: str) -> str:
    """line_number, from a text's blocks and lines_before of them."""
    i = f"cast(({at}) DIV {BLOCK} AS int)"
    head = f"substring(coalesce(get({blocks_}, {i}), ''), 1, ({at}) - {i} * {BLOCK})"
    return f"1 + coalesce(get({before}, {i}), if(size({before}) = 0, 0, element_at({before}, -1))) + length({head}) - length(replace({head}, '\\n', ''))"


#: Python's str.splitlines: these end a line, and a text's end after one is no further line.
LINE_ENDS = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def split_lines(text: str) -> str:
    parts = f"split({text}, {lit(LINE_ENDS)}, -1)"
    return f"if(length({text}) = 0, {empty('string')}, if(element_at({parts}, -1) = '', slice({parts}, 1, size({parts}) - 1), {parts}))"


def estimate_tokens(value: str) -> str:
    return f"cast(ceil(octet_length({value}) / 4.0) AS int)"


def json_string(value: str) -> str:
    """A JSON string: short escapes for the usual control characters, \\u00XX for others, nothing else escaped."""
    return f"substring(to_json(array({value})), 2, length(to_json(array({value}))) - 2)"


def strip(value: str) -> str:
    """Without white space at both ends."""
    return f"regexp_replace({value}, {rx(r'^\s+|\s+$')}, '')".replace("(?dU)^", "(?U)^")


def tokens(text: str) -> str:
    """Distinct lower-cased ASCII words without stopwords, and bigrams of CJK runs (or a lone character)."""
    words = f"filter(transform(regexp_extract_all({text}, '(?i)[a-z0-9]+(?:[_-][a-z0-9]+)*', 0), w -> lower(w)), w -> NOT array_contains(array({', '.join(map(lit, fixed.STOPWORDS))}), w))"
    run = "[\\\\u3400-\\\\u4dbf\\\\u4e00-\\\\u9fff]+"
    pairs = f"flatten(transform(regexp_extract_all({text}, '{run}', 0), r -> if(length(r) = 1, array(r), transform(sequence(1, length(r) - 1), i -> substring(r, i, 2)))))"
    return f"array_distinct(concat({words}, {pairs}))"


def line_score(text: str, toks: str, task: str) -> str:
    """Lexical relevance: task words, failure words (two languages), severities and 5xx codes."""
    zh = " + ".join(f"if(contains({text}, {lit(t)}), 3, 0)" for t in fixed.FAILURES_ZH)
    return (
        f"(4 * size(array_intersect({toks}, {task})) + 3 * size(array_intersect({toks}, array({', '.join(map(lit, fixed.FAILURES))}))) + {zh} "
        f"+ 5 * regexp_count({text}, {rx(r'\b(?:ERROR|FATAL)\b')}) + 4 * regexp_count({text}, {rx(r'(?<!\d)5\d{2}(?!\d)')}))"
    )


def safe_source(path: str) -> str:
    """A path without what points outside: forward slashes, no drive or root, no empty or dot parts, nothing before '..'."""
    p = f"replace({path}, '\\\\', '/')"
    parts = f"filter(split({p}, '/', -1), x -> x NOT IN ('', '.'))"
    last = f"coalesce(try_element_at(filter(split({p}, '/', -1), x -> x NOT IN ('', '.', '..')), -1), '<input>')"
    return (
        f"CASE WHEN {p} rlike '^/|^[A-Za-z]:/' OR array_contains({parts}, '..') THEN {last} "
        f"WHEN size({parts}) = 0 THEN '<input>' ELSE array_join({parts}, '/') END"
    )


def supported_extension(path: str) -> str:
    name = f"lower(substring_index({path}, '/', -1))"
    return f"({name} = '.env' OR {name} LIKE '.env.%' OR regexp_extract({name}, '[^.].*\\\\.([^.]+)$', 1) IN ({', '.join(map(lit, fixed.EXTENSIONS))}))"
