import html as H
import random
import re



from martmend.llm import wrapper
from martmend.llm.wrapper import Reader, Tree


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrapper.extract(df).collect()}


def nodes(a, b, x=0, y=0):
    """Brute force: the most pairs of a tree matching whose roots are paired, over all ways to pair children in order."""
    left, right = a.children()[x], b.children()[y]

    def best(i, j):
        if i == len(left) or j == len(right):
            return 0
        found = max(best(i + 1, j), best(i, j + 1))
        if a.labels[left[i]] == b.labels[right[j]]:
            found = max(found, nodes(a, b, left[i], right[j]) + best(i + 1, j + 1))
        return found

    return 1 + best(0, 0)


def random_tree(rng, n):
    tree = Tree()
    for _ in range(n):
        tree.add(rng.randrange(len(tree.labels)), rng.choice("pqr"))
    return Tree.of(tree.text())


def test_tree_matching_is_largest_and_a_wrapper_holds_both_trees():
    rng = random.Random(1)
    for _ in range(60):
        a, b = random_tree(rng, rng.randint(0, 9)), random_tree(rng, rng.randint(0, 9))
        to = wrapper.aligned(a, b)
        assert len(to) == nodes(a, b) and all(a.labels[x] == b.labels[y] for y, x in to.items())
        assert all(to[b.parents[y]] == a.parents[x] for y, x in to.items() if y)
        both = wrapper.merged(a, b)
        assert len(both.labels) == len(a.labels) + len(b.labels) - len(to)
        for tree in (a, b):
            assert len(wrapper.aligned(both, tree)) == len(tree.labels)


def test_reader_folds_siblings_and_mends_markup():
    outline, blocks = Reader.page("<p>One<p>Two <b>and</b> a<br>half &amp three</p><ul><li>x<li>y</ul><script>'</p>'</script><div hidden>no</div>tail &am")
    assert outline.split("\n") == ["1 p", "1 ul", "2 li"]
    assert [t for _, t, _ in blocks] == ["One", "Two and a half & three", "x", "y", "tail &am"]
    assert Reader.page(None) == ("", []) and Reader.page("<select><option>a<div><p>b")[1] == []
    assert Reader.page("<div id=abc>x</div><div id=xyz>y</div><div id=Side-bar>z</div>")[0].split("\n") == ["1 div"] and Reader.page("<div id=Comments>z</div>")[0] == "1 div#comments"
    deep = Reader.page("<div>" * 5000 + "deep" + "</div>" * 5000)
    assert deep[0].count("\n") == wrapper.DEPTH - 1 and deep[1][0][1] == "deep"


def page(rng, i, kind):
    """A page and its article: with elements that say what they are, or with class names without meaning."""
    title, body = words(rng, 4), [words(rng, rng.randint(12, 40)) for _ in range(rng.randint(2, 6))]
    links = "".join(f'<li><a href="/{k}">{words(rng, 2)}</a></li>' for k in range(6))
    paragraphs = "".join(f"<p>{p}</p>" for p in body)
    if kind == "named":
        text = f"<html><head><title>{title}</title></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><ul>{links}</ul></nav><main><article><h1>{title}</h1>{paragraphs}<div class='share-box'>Share this {i}</div></article><section id='comments'><article class='comment-{i}'><p>{words(rng, 30)}</p></article></section></main><aside><p>{words(rng, 20)}</p></aside><form><p>Sign up {i}</p></form><footer>About us</footer></body></html>"
    else:
        text = f"<html><body><div class='x1'><ul>{links}</ul></div><div class='x2'><div class='x3'><h1>{title}</h1>{paragraphs}<p>All rights are reserved by the owners of this site.</p></div><div class='x4'><p>Read our mobile edition wherever you are, free of charge.</p></div></div><div class='x5'>Made with care in the valley by a small team.</div></body></html>"
    return text, " ".join([title, *body])


def test_content_of_hosts_with_and_without_names(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for i in range(40):
        kind = "named" if i % 2 else "plain"
        html, article = page(rng, i, kind)
        rows.append((i, f"https://{kind}.example.org/{i}", html))
        expected[i] = article
    assert texts(spark, rows) == expected


def test_near_copies_are_no_template(spark):
    rng = random.Random(3)
    body = [words(rng, 30) for _ in range(8)]
    rows, expected = [], {}
    for i in range(60):
        own = [*body]
        own[rng.randrange(8)] = words(rng, 60)
        if i % 10 == 0:
            own = [words(rng, 30) for _ in range(8)]
        rows.append((i, "http://copies.example.org/", "<body><article><h1>Same title</h1>" + "".join(f"<p>{p}</p>" for p in own) + "</article></body>"))
        expected[i] = " ".join(["Same title", *own])
    found = texts(spark, rows)
    kept = sum(found[i] == expected[i] for i in expected)
    assert kept == len(rows)


def test_odd_rows_and_joined_rules(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(1, None, None), (2, "", ""), (3, "no url", "just text &eacute;&nbsp;x"), (None, "http://a.org", "<p>a</p>"), (4, "http://a.org", "<p>a</p>"), (4, "http://a.org", "<p>a</p>"), (5, "http://a.org", "<p>" + "long " * 100_000)]
    rows += [(10 + i, "http://b.org", page(rng, i, "plain")[0]) for i in range(8)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key_ string, text int")
    found = wrapper.extract(df)
    assert found.columns == ["page_id", "url", "html", "key_", "text"]
    first = sorted((str(r.page_id), r.text) for r in found.collect())
    assert ("1", "") in first and ("2", "") in first and ("3", "just text é x") in first and first.count(("4", "a")) == 2 and ("None", "a") in first
    assert ("5", ("long " * 100_000).strip()) in first
    monkeypatch.setattr(wrapper, "BROADCAST", -1)
    assert sorted((str(r.page_id), r.text) for r in wrapper.extract(df).collect()) == first
    assert wrapper.extract(df.limit(0)).count() == 0


def test_query_against_a_plain_version(spark):
    from martmend.llm import queries

    path = "/root/testdata/sf0.001"
    found = {r.page_id: r for r in queries.op11_extract(spark, path).collect()}
    pages = spark.read.parquet(f"{path}/pages.parquet").collect()
    assert len(found) == len(pages)
    for r in pages:
        inner = re.sub("</?b>", "", re.search("<article>(.*?)(</article>|$)", r.html or "<article>", re.S)[1])
        text = " ".join(H.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert (found[r.page_id].text, found[r.page_id].n_chars) == (text, len(text))


