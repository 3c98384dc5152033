"""Article text, Merkle trees and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from rxloom.llm import html_extraction, merkle_manifest, periodic_runs

PROSE = "This is a paragraph of the article, and it has the words that running text of this kind would have in it."


def test_pages_hold_what_their_articles_say(spark):
    """The given pages against an expression that knows how they are made."""
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        want[r["page_id"]] = (r["url"], "\n".join(b for b in blocks if b))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_extraction.op11_html_extraction(spark, SF).collect()}
    assert {k: v[:2] for k, v in got.items()} == want and all(len(v[1]) == v[2] for v in got.values())


def test_page_furniture_goes():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>"
        f"<div class='cookie-notice'><p>{PROSE}</p></div><div class='layout has-sidebar'><article class=post><header><h1>Head</h1></header><p>{PROSE}</p>"
        f"<p>Short.</p><div class=ad>{PROSE}</div><script>var t='</p>';</script><p>End &amp; more&nbsp;x &#233;<br>y</p><form>Name <input> <p>{PROSE}</p></form>"
        f"<ul><li><a href=y>Read on in another place</a></li></ul><p>Last<!-- c --> words</p></article><aside><p>{PROSE}</p></aside>"
        f"<div id=comments><article class=comment><p>{PROSE}</p></article></div></div><footer>c</footer></body></html>"
    )
    assert html_extraction.main_text(page).split("\n") == ["Head", PROSE, "Short.", "End & more x é y", "Last words"]


def test_short_blocks_inherit_from_their_neighbours():
    """Without an article element: beside running text they stay, beside lists of links they go."""
    links = "".join(f"<p><a href={k}>place number {k}</a></p>" for k in range(4))
    page = f"<body>{links}<p>Small print.</p>{links}<h2>Part</h2><p>{PROSE}</p><p>So.</p><p>{PROSE}</p>{links}<p>Far.</p>{links}"
    assert html_extraction.main_text(page).split("\n") == ["Part", PROSE, "So.", PROSE]
    assert html_extraction.main_text("<h1>Only</h1><p>Short text.<nav>Home</nav>") == "Only\nShort text."
    assert html_extraction.main_text(f"<form id=all><div><main><p>{PROSE}<p>x <button>go</button> y</main></div></form>") == f"{PROSE}\nx y"


def test_broken_pages():
    text = html_extraction.main_text
    assert [text(x) for x in (None, "", "<", "<p", "<!--", "<script>x", "a < b")] == ["", "", "<", "", "", "", "a < b"]
    assert text("<p>one <b>two<p title=\"a>b\">three</p><i \"<p>four</p>") == "one two\nthree\nfour"
    for many in ("<p>", "<div class=ad>", "<td>x", "<ul><li>x", "</div>", "<a \"", "<script>", "<h1>x<dd>"):
        text(many * 50_000)


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def climb(nodes: list[str], fan: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and what stands left and right of each node's ancestors."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for x, i in enumerate(at):
            run = nodes[i // fan * fan : i // fan * fan + fan]
            paths[x].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
            at[x] = i // fan
        nodes = [H("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def plain_manifest(rows: list[tuple], fan: int) -> list[tuple]:
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(map(field, r)))
    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    langs: dict = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own], fan)))
    root, tops = climb([t[1] for t in trees], fan)
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            cur = leaf((*r[:4], low(r[4]))) if tampered else leaf(r)
            for left, right in path + top:
                cur = H(left + cur + right)
            out.append((r[0], leaf(r), subroot, root, H("".join(a + b for a, b in path + top)), cur, cur == root))
    return sorted(out, key=repr)


def test_manifest_equals_plain_trees(spark):
    """Nulls, ties, repeated rows, languages of one document, levels with one node over, one and several rounds of buckets."""
    random.seed(5)
    rows = [(random.choice([None, *range(400)]), random.choice(["s", None]), random.choice(["en"] * 6 + ["de", None, "", "ü"]), k % 7, random.choice([None, "", "Text A", f"Öl Z{k}", "lower"])) for k in range(700)]
    rows += rows[:20] + [(9, "s", "x1", 1, "ONE"), (10, "s", "x2", None, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    columns = ["doc_id", "leaf", "subroot", "root", "proof", "folded", "verified"]
    for fan, bucket in ((8, 4096), (8, 8), (2, 4), (3, 9)):
        got = merkle_manifest.manifest(docs, tampered, bucket, fan).select(columns)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows, fan)
    alone = merkle_manifest.manifest(docs.filter("lang = 'x1'"), tampered).collect()
    assert [tuple(r[c] for c in columns) for r in alone] == plain_manifest(rows[-2:-1], 8)
    assert merkle_manifest.manifest(docs.limit(0)).collect() == []


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.add((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    random.seed(3)
    for _ in range(1500):
        k, n = random.choice([1, 2, 2, 3, 4, 9]), random.randrange(0, 130)
        w = [random.randrange(k) for _ in range(n)]
        if random.random() < 0.7 and n > 5:
            a = random.randrange(n)
            p = 1 + (n - a) // (3 + random.randrange(8))
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
        if random.random() < 0.4:
            at, unit = random.randrange(len(w) + 1), [random.randrange(3) for _ in range(random.randrange(1, 5))]
            w[at:at] = unit * random.randrange(1, 9)
        assert periodic_runs.runs(np.array(w, dtype=np.int64)) == plain_runs(w)


def test_long_runs_stay_fast():
    for w, n in (([0] * 300_000, 1), (list(range(30_000)) * 4, 1), ([0, 1, 0, 2] * 50_000, 1), (list(range(200_000)), 0)):
        assert len(periodic_runs.runs(np.array(w))) == n


def test_op13_of_documents_equals_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).collect()
    texts = {r["doc_id"]: r["text"] for r in docs if len((r["text"] or "").split()) < 250}
    got = {r["doc_id"]: r for r in periodic_runs.op13_periodic_runs(spark, SF).collect()}
    cycles = 0
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = plain_runs(w)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        want = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], H(lines), H(" ".join(x for k, x in enumerate(w) if k not in gone)))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == want
        cycles += bool(found)
    assert cycles > 3


def test_runs_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 7), (None, "b c " * 5), (4, "a " * 7), (5, "x y " * 6)]
    found = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r["id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=repr)
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 7, [(0, 7, 1)], "a"), (0, 10, [(0, 10, 2)], "b c"), (4, 7, [(0, 7, 1)], "a"), (5, 6, [(0, 6, 1)], "x y")], key=repr)
