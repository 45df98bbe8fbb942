import json
import random

from lumenveil.llm import html as H

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href=/>Home</a><li>More</ul></nav>"
    "<div class=\"ad\">Buy {n}</div><article><h1>Title {n}</h1><p><b>First &amp; line {n}<br><p>Second\n   line {n}</p><div class='comments'>Nice {n}</div></article>"
    "<aside>side</aside><footer>&copy; host {n}</footer>"
)


def test_template_and_text(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(n=i)) for i in range(8)]
    rows += [(100, None, None), (101, "https://b.example/x", ""), (102, "https://c.example/", "<p>alone <form>f</form>here"), (103, "https://a.example/odd", "<main>plain &lt;b&gt;</main>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in H.main_text(df).collect()}
    for i in range(8):
        assert got[i]["text"] == f"Title {i}\nFirst & line {i}\nSecond line {i}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == got[101]["text"] == "" and got[100]["n_chars"] == 0
    assert got[102]["text"] == "alone\nhere" and got[103]["text"] == "plain <b>"
    assert H.main_text(df.limit(0)).count() == 0


def test_host_without_article_elements(spark):
    page = "<body><div id=top><span>Site name</span><a href=/>x</a></div><div class=text><p>Story {n} goes on for {n} long words and more of them</p><p>and ends {n}</p></div><div class=sidebar>links {n}</div>"
    rows = [(i, "http://plain.example/p", page.format(n="w" * (i + 3))) for i in range(6)]
    got = H.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    for r in got:
        n = "w" * (r["page_id"] + 3)
        assert r["text"] == f"Story {n} goes on for {n} long words and more of them\nand ends {n}"


def deduced(pages):
    """The host's template by comparing whole occurrence vectors."""
    of = [H.tokens(p) for p in pages]
    every = {t: v for got in of for t, v in got.items()}
    vector = {t: tuple(got[t][0] if t in got else 0 for got in of) for t in every}
    number = {v: i for i, v in enumerate(dict.fromkeys(vector.values()))}
    found = []
    for t, (_, up, key, main, *_) in every.items():
        own = [got[t] for got in of if t in got]
        if len(own) >= max(2, H.SUPPORT * len(pages)):
            sums = {"first": sum(o[4] for o in own) / len(own), "text": sum(o[5] for o in own), "links": sum(o[6] for o in own)}
            found.append({"token": t, "up": up, "key": key, "main": main, "support": len(own), "total": sum(vector[t]), "class": number[vector[t]]} | sums)
    found.sort(key=lambda t: (-t["support"], t["first"], t["token"]))
    return H.deduce(found, len(pages))


def template_of(spark, pages):
    rows = [(i, "https://a.example/", p) for i, p in enumerate(pages)]
    got = H.templates(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    return json.loads(got[0]["template"]) if got else None


def even(template):
    return {k: sorted(v) if isinstance(v, list) else {str(a): sorted(b) for a, b in v.items()} for k, v in template.items()}


def token(*keys):
    el = H.Element("#", "", None)
    for k in keys:
        name, _, mark = k.partition(".")
        el = H.Element(name, f'class="{mark}"' if mark else "", el)
    return el.token


def test_template_has_frame_and_repeats(spark):
    pages = [PAGE.format(n=i).replace("<p>Second", "<p>x" * (i % 3) + "<p>Second") for i in range(9)]
    t = template_of(spark, pages)
    assert t["content"] == [token("html", "body", "article")] and token("html", "body", "nav") in t["frame"]
    assert token("html", "body", "nav", "ul", "li") in t["repeated"][str(token("html", "body", "nav", "ul"))]
    assert even(t) == even(deduced(pages))


# Class names that mean nothing, no element whose name tells content from the rest.
def nameless(i):
    word = f"w{i}x"
    records = "".join(f"<div class=kb><div class=kc>Reader {word}{j}</div><div class=kd>says {word} {j} of it</div></div>" for j in range(1 + i % 3))
    return (
        f"<html><body><div class=za><span>Site</span> <a href=/>Start</a></div><div class=zb><div class=zc><h1>Head {word}</h1><div class=q>Send this on</div>"
        f"<p>Story {word} goes on and on with {word} for many words</p><p>Part two of {word} has some more words yet</p><p>The same last line</p>"
        f"<div class=ka>{records}</div></div><div class=zd><div>Old tale {word}</div></div></div><div class=ze>All rights kept</div>"
    ), f"Head {word}\nStory {word} goes on and on with {word} for many words\nPart two of {word} has some more words yet\nThe same last line"


def test_content_without_telling_names_comes_from_the_template(spark):
    pages = [nameless(i) for i in range(12)]
    rows = [(i, "http://plain.example/p", p) for i, (p, _) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i, (page, text) in enumerate(pages):
        assert got[i] == text
        bare = H.extract(page, None)  # without the template everything comes out
        assert "Site" in bare and "Send this on" in bare and "Reader" in bare and "All rights kept" in bare
    t = template_of(spark, [p for p, _ in pages])
    way = ("html", "body", "div.zb", "div.zc")
    assert t["content"] == [token(*way)] and set(t["out"]) == {token(*way, "div.q"), token(*way, "div.ka")}
    assert even(t) == even(deduced([p for p, _ in pages]))


def test_what_never_changes_inside_an_article_goes_unless_pages_are_copies(spark):
    page = "<body><article><h1>T{n}</h1><div>Follow us</div><p>Body {n} {n} {n} {n}</p></article></body>"
    rows = [(i, "http://a.example/", page.format(n=f"n{i}")) for i in range(5)] + [(10 + i, "http://b.example/", page.format(n="n")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Tn3\nBody n3 n3 n3 n3" and got[12] == "Tn\nFollow us\nBody n n n n"


def test_random_hosts_against_whole_vectors(spark):
    r = random.Random(8)
    for _ in range(4):
        names = [r.choice(["div", "section", "ul", "p", "h2", "span", "a", "article"]) + r.choice(["", " class=a", " class=b1", " id=c"]) for _ in range(7)]

        def part(depth=0):
            if depth > 3 or r.random() < 0.3:
                return f"text {r.randrange(4)} "
            n = r.choice(names)
            return f"<{n}>" + "".join(part(depth + 1) for _ in range(r.randrange(4))) + f"</{n.split()[0]}>"

        pages = ["<html><body>" + "".join(part() for _ in range(6)) for _ in range(r.randrange(3, 9))]
        assert even(template_of(spark, pages)) == even(deduced(pages))


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, "https://a.example/", PAGE.format(n=1)) for i in range(5)]
    assert {r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()} == {"Title 1\nFirst & line 1\nSecond line 1"}


def test_templates_of_many_texts_and_tags_are_whole(spark):
    name = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    menu = "<div class=list>" + "".join(f"<span>entry {i}</span>" for i in range(450)) + "</div>"
    page = "<body>" + menu + "<div class=text><p>{n}</p><p>Same last line</p></div>"
    rows = [(i, "http://texts.example/p", page.replace("{n}", f"story{i} " * 1500)) for i in range(5)]
    many = "<body>" + "".join(f"<div class=q{name(i)}>x</div>" for i in range(450)) + "<article><p>{n}</article>"
    rows += [(10 + i, "http://tags.example/p", many.replace("{n}", f"story {i}")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.main_text(df).collect()}
    assert [got[i] for i in range(5)] == [" ".join([f"story{i}"] * 1500) + "\nSame last line" for i in range(5)]
    template = {r["host"]: json.loads(r["template"]) for r in H.templates(df).collect()}
    assert template["tags.example"]["content"] == [token("body", "article")] and len(template["texts.example"]["fixed"]) == 451


def test_odd_markup():
    assert H.extract("<article>a<b>b</b> c<br>d &am &amp", None) == "ab c d &am &"
    assert H.extract("<article>" + "<p>x" * 5000, None).count("\n") == 4999
    assert H.extract("<" * 20000, None) is not None
    assert H.extract("a < b <!-- c", None) == "a < b"
    assert H.extract("<article>x <math><mi>a</mi></math> <video>no film</video> &am<b>p;</b> <select><option>one</select></article>", None) == "x a no film &amp;\none"
    deep = "<article>" + "<div><b>" * 20000 + "end"
    assert H.extract(deep, None) == "end" and len(H.tokens(deep)) == 40003


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(i % 3, "https://a.example/", PAGE.format(n=i % 3)) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS host", "1 AS token", "'y' AS text", "2L AS n_chars", "'z' AS template")
    got = H.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["text"] for r in got.collect()) == sorted(f"Title {i}\nFirst & line {i}\nSecond line {i}" for i in (0, 0, 1, 1, 2, 2))
