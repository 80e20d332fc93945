"""Operator 3: held-out pages, the tables' template, and broken markup."""

import html
import random
import re

import pytest

from mixshard.llm import html as X



def test_training_table_is_learned():
    tree, wrong, total = X.trained_tree(), 0, 0
    for page in X.PAGES:
        found = X.blocks(page)
        keep = tree.share(X.features(found)) >= 0.5 if found else []
        wrong += sum(bool(k) != m for k, (_, _, m) in zip(keep, found))
        total += len(found)
    assert total > 150 and wrong <= 0.03 * total


def test_held_out_pages():
    """Leave-one-out over the labelled table."""
    right = total = 0
    tables = [X.blocks(p) for p in X.PAGES]
    import numpy as np
    for i, own in enumerate(tables):
        rest = [t for j, t in enumerate(tables) if j != i]
        tree = X.Tree(np.concatenate([X.features(t) for t in rest]), np.array([m for t in rest for _, _, m in t]))
        keep = tree.share(X.features(own)) >= 0.5 if own else []
        right += sum(bool(k) == m for k, (_, _, m) in zip(keep, own))
        total += len(own)
    assert right >= 0.9 * total


CASES = [
    (None, ""), ("", ""), ("   ", ""), ("<article></article>", ""),
    ("<article><p>a&amp;b &lt;c&gt; &eacute;&#x41;\n\t d&nbsp;e</p></article>", "a&b <c> éA d e"),
    ("<article><h1>T</h1><p>x <b>y</b>z<br>w</p><script>var p='<p>no</p>'</script><style>p{}</style></article>", "T x yz w"),
    ("<article><p>one<p>two<!-- <p>no</p> --></article><footer>(c) some words of a footer that is long enough</footer>", "one two"),
    ("<nav><a href=x>m</a></nav><article><p>1 < 2 and 3 > 2</p><aside>side words</aside><form>f</form><section class='comments'><p>reader words</p></section></article>", "1 < 2 and 3 > 2"),
    ("<article><p>open <b>bold", "open bold"), ('<article><p title="a>b">q</p><p class="notice">n</p><p>r</p></article>', "q r"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert X.main_text(page) == text


def test_pages_table(spark):
    """The tables' own template, read by an independent expression."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"], r["url"]) for r in X.q_html(spark, "/root/testdata/sf0.01").collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        parts = re.split(r"</?(?:p|h1|br)>", body.group(1)) if body else []
        want = " ".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts) if x)
        assert got[r["page_id"]] == (want, len(want), r["url"])


def test_rows_and_long_pages(spark):
    r = random.Random(0)
    junk = "".join(r.choices("<>/abp \"'=!-&;", k=200_000))
    df = spark.createDataFrame([(None, "u", "<article>a</article>", "t"), (1, None, junk, "t"), (1, None, junk, "t"), (2, "v", "<p>" + "word " * 200_000, "t")], "page_id long, url string, html string, text string")
    got = X.extract(spark, df).collect()
    assert len(got) == 4 and sorted(str(x["id"]) for x in got) == ["1", "1", "2", "None"]
    assert {x["n_chars"] for x in got if x["id"] == 2} == {5 * 200_000 - 1}
    assert X.extract(spark, df.where("false")).count() == 0
