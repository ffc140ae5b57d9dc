"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import time
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatloom.llm import bpe, exact_dedup, html_extract, line_dedup, lm_score, minhash, mixing, quality_rules, token_output, url_filter
from chatloom.llm.common import scratch, stored

WORD_BPE, BYTE_BPE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
#: Names that the operators use inside; a caller's columns may have them too.
CLASHES = ["h", "t", "w", "size", "source_size", "doc", "copy", "bands", "row", "part", "n", "kept", "ids", "component", "_text",
           "copies", "number", "_row", "_copy", "_stats", "_q_t", "_id", "_n", "_bad", "_hash", "_s", "_prune", "_many", "_at", "_now", "_gone", "_first",
           "_cells", "_c", "_base", "_lead", "_blank", "rate", "target", "sid", "block", "total", "docs", "decoded", "n_tokens", "quality"]


def odd_rows(seed=3):
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "Delta,", "épée", "zeta.", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = say(30_000)
    shared = "this line is shared by many documents and is long enough to count"
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (3, "word", "b"), (4, long, "b"), (5, long, None), (None, say(30), "c"), (7, "x" * 5_000, "c"), (8, "日本語 テスト 👩‍👩‍👧", "c")]
    rows += [(9, say(40), "a")] * 3
    rows += [(10 + i, f"{say(20)}\n  {shared.upper() if i % 2 else shared} \n{say(15)}", "abc"[i % 3]) for i in range(12)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(odd_rows(), "doc_id bigint, text string, source string")
    for c in CLASHES:
        frame = frame.withColumn(c, F.lit("clash"))
    return stored(frame.repartition(3))


@pytest.fixture(scope="module")
def none(odd):
    return stored(odd.where("false"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 0), (9, 1), (10, 1), (11, None), (99, 0), (None, 1), (12, 1), (12, 1)], "doc_id bigint, quality int")


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_exact_dedup(odd, none):
    got = exact_dedup.classes(odd, keep="largest").collect()
    rows = odd.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = exact_dedup.keep_rows(odd)
    assert kept.columns == odd.columns
    kept = kept.collect()
    assert len(kept) == len(groups)
    assert {(r.doc_id, r.text) for r in kept} == {
        (min((i for i in ids if i is not None), default=None), next(x.text for x in rows if (x.text or "") == t and x.doc_id == min((i for i in ids if i is not None), default=None)))
        for t, ids in groups.items()}
    assert exact_dedup.classes(none).count() == exact_dedup.keep_rows(none).count() == 0


def test_exact_dedup_compares_bytes(odd):
    """Texts that share the hash stay apart."""
    weak = {r.doc_id: r.keep_id for r in exact_dedup.classes(odd, hash=lambda t: F.lit(b"same")).collect()}
    assert weak == {r.doc_id: r.keep_id for r in exact_dedup.classes(odd).collect()}


def brute_stats(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(odd, none, labels):
    judged, _ = quality_rules.judge(odd, labels)
    got = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = [(r.doc_id, *(s := brute_stats(r.text)), s[0] < 10 or 100 * s[4] > 20 * s[0]) for r in odd.collect()]
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality_rules.keep_rows(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judge(none, labels)[0].count() == 0
    assert quality_rules.judge(odd, labels.where("false"))[1] == []


def test_repeats_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a ", "b ", "a\n", "c  ", "#", "é "]) for _ in range(rng.randrange(60)))) for i in range(300)]
    stats = quality_rules.with_stats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for r in stats:
        assert tuple(r["_stats"])[:5] == brute_stats(r.text), r.text


def test_quality_rules_learn_thresholds(spark):
    """A planted rule is found and clean texts stay."""
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(900):
        bad = i % 3 == 0
        rows.append((i, " ".join("w" * rng.randrange(1, 12) + str(rng.randrange(9)) + ("$$" if bad and (k < 3 or rng.random() < 0.1) else "") for k in range(50))))
        marks.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    judged, rules = quality_rules.judge(docs, spark.createDataFrame(marks, "doc_id bigint, quality int"))
    assert rules and rules[0][0].name == "symbol_share"
    assert {r.doc_id for r in judged.where("NOT kept").collect()} == {i for i, q in marks if q == 0}


def brute_lines(rows, min_chars=40, min_docs=5):
    blanks = " \t\n\x0b\x0c\r"
    lower = {c: c + 32 for c in range(65, 91)}
    keys = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            keys.setdefault(line.strip(blanks).translate(lower), set()).add(-1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(k := x.strip(blanks).translate(lower)) < min_chars or len(keys[k]) < min_docs or max(keys[k]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=key)


def test_line_dedup(odd, none):
    got = line_dedup.apply(odd, line_dedup.bitmaps(odd)).collect()
    assert sorted(map(tuple, got), key=key) == brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert sum(r.n_dropped for r in got) >= 10
    assert line_dedup.apply(none, line_dedup.bitmaps(none)).count() == 0


def test_line_dedup_common_line_over_many_parts(spark):
    """Runs that cross parts and batches: few keys, many documents, repeats inside a document."""
    rng = random.Random(2)
    pool = [f"line number {k} with some more text to be long enough {k}" for k in range(6)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {i} {rng.random()} padding padding padding padding" for _ in range(9))) for i in range(2500)]
    rows += [(5000 + k, f"rare line {k % 4} that is found in a few documents only ...") for k in range(15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = line_dedup.apply(docs, line_dedup.bitmaps(docs)).collect()
    assert sorted(map(tuple, got), key=key) == brute_lines(rows)


def test_bpe_matches_library(odd, none):
    library = Tokenizer.from_file(WORD_BPE)
    got = bpe.decode(bpe.encode(odd, WORD_BPE), WORD_BPE).collect()
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got), key=key) == sorted(want, key=key)
    assert bpe.decode(bpe.encode(none, WORD_BPE), WORD_BPE).count() == 0


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_bpe_on_odd_strings(path):
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x400), *range(0x3040, 0x30A0), 0x1F600, 0x2028, 0x2003, 0x85, 0xA0, 0x300, 0x301]] + list(" \n'") * 20
    texts = ["", " ", "it's I'LL", "<|endoftext|>a <|startoftext|>", "ΣΑΣ ΟΔΟΣ", "x" * 700 + "!" * 300, "½ ² ١٢"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(500)]
    for text, raw in zip(texts, own.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, text
        assert own.decode(raw) == library.decode(ids, skip_special_tokens=False)


def test_pair_tree_is_greedy_merging():
    """The root's leftmost lowest pair, merge by merge, against a plain loop."""
    rng = random.Random(6)
    own = bpe.Bpe(WORD_BPE)
    ranks = {(int(k >> 32), int(k & 0xFFFFFFFF)): int(r) for k, r in zip(own.merges.keys, own.merges.rank_of)}
    for _ in range(200):
        piece = "".join(rng.choice("theranio") for _ in range(rng.randrange(1, 40)))
        symbols = [int(own.inner[b]) for b in piece.encode()[:-1]] + [int(own.last[piece.encode()[-1]])]
        while len(symbols) > 1:
            rank, at = min((ranks.get(p, 1 << 40), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 40:
                break
            symbols[at : at + 2] = [int(own.merges.merged[rank])]
        assert np.frombuffer(own.encode_pieces([piece])[0], "<u4").tolist() == symbols


def test_token_output(spark, odd, none):
    library = Tokenizer.from_file(BYTE_BPE)
    out = scratch(spark)
    token_output.write(odd, out, BYTE_BPE)
    got = token_output.with_crc32(token_output.read(spark, out)).collect()
    want, start = [], 0
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert [r.doc_id for r in token_output.lookup(spark, out, [4, 8]).orderBy("doc_id").collect()] == [4, 8]
    plan = token_output.lookup(spark, out, [4])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    empty = scratch(spark)
    token_output.write(none, empty, BYTE_BPE)
    assert token_output.read(spark, empty).count() == 0


def test_token_encoder_on_odd_strings():
    library, own = Tokenizer.from_file(BYTE_BPE), token_output.Encoder(BYTE_BPE)
    rng = random.Random(8)
    pool = [chr(c) for c in [*range(1, 0x250), 0x1F600, 0x2028, 0x2003, 0x85, 0xA0]] + [" "] * 60 + ["\n"] * 8
    texts = ["", " ", "a ", "  a", "<|endoftext|>a b", "a\n b", "a\n\n b \n c", "x  y", "\n"] + ["".join(rng.choice(pool) for _ in range(50)) for _ in range(1500)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


class Asked:
    """A tokenizer that counts the characters it is asked for."""

    def __init__(self, library):
        self.library, self.characters = library, 0

    def encode_batch_fast(self, texts, **options):
        self.characters += sum(map(len, texts))
        return self.library.encode_batch_fast(texts, **options)


def test_token_encoder_asks_once_for_a_word():
    library, own = Tokenizer.from_file(BYTE_BPE), token_output.Encoder(BYTE_BPE)
    own.library = asked = Asked(library)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeéüж") for _ in range(12)) for _ in range(200)]
    signs = [",", ".", ";", "!?", ")", "...", "\n", "\n\n  ", "  ", ".\n", "\t", "'s", "-", ": "]
    # Every word with every sign: its signs and the blanks around do not make it new.
    texts = [" ".join(f"{w}{s}" for w in words) for s in signs]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert asked.characters < 5 * sum(map(len, words))
    own.encode(texts)
    assert asked.characters < 5 * sum(map(len, words))


@pytest.mark.parametrize("step", [token_output.SLICE, 1, 7])
def test_token_encoder_cuts_between_all_kinds_of_characters(step, monkeypatch):
    monkeypatch.setattr(token_output, "SLICE", step)
    library, own = Tokenizer.from_file(BYTE_BPE), token_output.Encoder(BYTE_BPE)
    around = ["", "a", "é", "1", ".", "'", " ", "\n", " \n", "\x1f", "\xa0", "\u3000", "日", "😀"]
    texts = [f"x{a}{chr(c)}{b}s" for c in [*range(0x180), *range(0x300, 0x304), 0x378, 0x5D0, 0x661, 0x7FF, 0x1680, 0x2009, 0x2014, 0x205F] for a in around for b in around][:: 1 if step > 7 else 50]
    texts += ["a <|", "endoftext", "|> b", "x" * 300 + ". " + "é" * 300, " " * 300 + "x", ""]
    wanted = library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, ids, want in zip(texts, own.encode(texts), wanted) if ids.tolist() != want.ids] == []


def test_token_encoder_leaves_other_patterns_to_the_library():
    library, own = Tokenizer.from_file(WORD_BPE), token_output.Encoder(WORD_BPE)
    texts = ["", "It's  a test.\n\n1234 Wörter", " x "]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_mixing(odd, none):
    rows = [r.asDict() for r in mixing.mix(odd).collect()]
    assert len(rows) == odd.count()
    size = {}
    for r in odd.collect():
        size[r.source] = size.get(r.source, 0) + brute_stats(r.text)[0]
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(size.values()), {}
    while True:  # the excess of full sources goes to the others by weight
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level >= 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3.0 * size[s] for s in over}
    target = {s: fixed.get(s, weight[s] * level) for s in names}
    for r in rows:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3
    assert mixing.mix(none).count() == 0


def test_mixing_meets_targets_and_is_stable(spark):
    rng = random.Random(9)
    rows = [(i, "w " * max(1, int(rng.lognormvariate(4, 1.2))), f"s{min(i % 9, 4)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(11)).toPandas()
    merged = first.merge(again, on="doc_id")
    assert (merged.copies_x == merged.copies_y).all()
    first["words"] = first["size"] * first["copies"]
    took = first.groupby("source").agg(words=("words", "sum"), target=("target", "first"))
    assert (abs(took.words / took.target - 1) < 0.01).all()
    # Rates are tilted by size: one exponent per source.
    free = first[(first.rate < 3) & (first.rate > 0)]
    tilt = np.log(free.rate) / free["size"]
    assert (tilt.groupby(free.source).std() < 1e-6).all()


def test_url_filter(spark):
    lines = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]
    rules = [url_filter.parse_rule(x) for x in lines]
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q#f", "https://example.net/enx", "https://badexample.net/en/", "http://x.org/fr/", "http://org/fr/a", "http://x.org/FR/",
            "http://net", "http://net/", "http://e.example.com/de/?x", "a://b://c/d", "http://h.com?x/y", "http://É.org/fr/é", "x" * 5000, "http://x.org/fr/", "://q.net/z"]
    rng = random.Random(3)
    urls += [f"http://good{rng.randrange(50)}.org/fr/{rng.randrange(999)}" for _ in range(150)] + [f"http://spam{rng.randrange(50)}.net/buy/{rng.randrange(999)}" for _ in range(150)]
    urls += ["http://spam77.xyz/buy/77", "http://good77.xyz/fr/77"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
            path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best.name if best else None), u
        assert got[i].verdict == (best.verdict if best else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert (got[len(urls) - 2].verdict, got[len(urls) - 1].verdict) == ("block", "allow")
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    alone = url_filter.judge(pages.where("page_id < 4"), rules).collect()  # nothing to learn from
    assert {r.verdict for r in alone} == {"allow"}


def test_url_model_is_a_distribution():
    """Probabilities of all next characters sum to 1 after any context."""
    contexts = {"": ({"a": 3, "b": 1}, {}), "a": ({"b": 2}, {}), "\x02": ({"a": 1}, {})}
    model = url_filter.Model(2, contexts, 3)
    table = model.tables()[0]
    for start in ("", "a", "ab"):
        base = url_filter.log_prob(start, table, 2, 3)
        assert sum(math.exp(url_filter.log_prob(start + c, table, 2, 3) - base) for c in "abz") == pytest.approx(1)


PAGE = (
    '<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav><header><p>Site head.</p></header>'
    '<div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>One <b>bold</b>\n text.<p>Two &eacute;&nbsp;x<br>y.<ul><li>item</ul>'
    '<div class="advert">Buy it.</div><form><p>Mail?</p></form><section id="comments"><p>A reader says so.</p></section></article><aside><p>Side. Bar.</p></aside><footer>&copy; foot</footer></body></html>')


def test_html_extract(spark):
    pages = [(0, "u", None), (1, None, ""), (2, "u", PAGE), (3, "u", PAGE[: PAGE.index("Two &") + 9]), (4, "u", "<div><<< &am <p"), (5, "u", "<article>" + "<div>" * 3000 + "deep text here."),
             (6, "u", PAGE), (6, "u", PAGE), (7, "u", "<article><p>" + "long words. " * 50_000), (8, "u", "<!-- <article><p>x</p> -->"), (None, "u", "<nav>a</nav>")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    model = html_extract.fit(frame)
    got = sorted(html_extract.extract(frame, model).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    want = "Head & line\n\nOne bold text.\n\nTwo é x y.\n\nitem"
    assert [r.text for r in got][:5] == ["", "", want, "Head & line\n\nOne bold text.\n\nTwo &eacu", got[4].text]
    assert got[5].text == "deep text here." and got[6].text == got[7].text == want
    assert got[8].text == ("long words. " * 50_000).strip() and got[9].text == "" and got[10].text == ""
    assert all(r.n_chars == len(r.text) for r in got)
    empty = frame.where("false")
    assert html_extract.extract(empty, html_extract.fit(empty)).count() == 0


def test_html_keeps_article_text_with_furniture_words(spark):
    """Ids of headings and sections, and one class word, do not take article text away; advertisements go."""
    say = "This is a sentence of the article, and it goes on for a while. "
    body = (f'<h2 id="search-results">Search results</h2><p>{say * 2}</p><h3 id="login-form">Login form</h3><p>{say}</p>'
            f'<p class="meta">{say * 3}</p><section id="related-work"><h2>Related work</h2><p>{say}</p></section>')
    html = f'<html><body><nav><a href=/x>Menu</a></nav><article><h1>Head</h1>{body}</article><div class="ad">Buy it now.</div></body></html>'
    pages = [(0, "u", PAGE), (1, "u", html), (2, "u", html.replace("article>", "div>"))] + [(3 + i, "u", PAGE) for i in range(5)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(frame, html_extract.fit(frame)).collect()}
    meta = (say * 3).strip()
    want = ["Head", "Search results", (say * 2).strip(), "Login form", say.strip(), meta, "Related work", say.strip()]
    assert got[1].split("\n\n") == want
    # Without an article element a paragraph of class "meta" stays open to either reading.
    assert [x for x in got[2].split("\n\n") if x != meta] == [x for x in want if x != meta]


def test_html_ends_of_raw_elements_and_inline_objects():
    """A letter that lower case makes longer hides no closing tag; formulas and fallback texts are inline."""
    page = ("<article><p>\u0130stanbul is a city. <SCRIPT>var x;</SCRIPT>It goes on <STYLE>p{}</Style>here: "
            "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> and <object>a picture</object>.</p><p>Last one.</p></article>")
    model = html_extract.Model.from_counts({})
    assert html_extract.text_of_page(page, model) == "\u0130stanbul is a city. It goes on here: x=2 and a picture.\n\nLast one."


def test_html_messages_are_exact():
    """Sum-product marginals against the sum over all assignments of a small tree."""
    import itertools

    rng = np.random.default_rng(2)
    nodes = [html_extract.Node("x", p, 0) for p in (-1, 0, 0, 1, 1, 2)]
    values = np.stack([rng.integers(0, n, len(nodes)) for n in html_extract.FEATURES.values()], axis=1)
    model = html_extract.Model(np.log(rng.dirichlet([1, 1, 1], 3)).tolist(), [np.log(rng.dirichlet(np.ones(n), 3)) for n in html_extract.FEATURES.values()])
    mass = np.zeros(len(nodes))
    total = 0.0
    for states in itertools.product(range(3), repeat=len(nodes)):
        if states[0]:
            continue
        w = sum(model.node[k][s, v] for s, row in zip(states, values) for k, v in enumerate(row)) + sum(html_extract.NAMES[s, 0] for s in states)
        w = math.exp(w + sum(model.edge[states[n.parent]][states[i]] for i, n in enumerate(nodes) if i))
        total += w
        mass += w * (np.array(states) == html_extract.CONTENT)
    assert model.marginals(nodes, values) == pytest.approx((mass / total).tolist())


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def brute_groups(rows, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), find(i), find(i) == i) for i, s in sets), key=key)


def test_minhash(odd, none):
    for n in (2, 5):
        got = minhash.groups(odd, shingle=n).collect()
        assert sorted(map(tuple, got), key=key) == brute_groups([(r.doc_id, r.text) for r in odd.collect()], n)
    kept = minhash.keep_rows(odd)
    assert kept.columns == odd.columns
    assert minhash.groups(none).count() == minhash.keep_rows(none).count() == 0


def test_minhash_chains_and_families(spark):
    """Copies of copies, whose links go past the centre of their buckets, against brute force."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for f in range(12):
        family = [[word() for _ in range(rng.choice([12, 60, 200]))]]
        for _ in range(45):
            new = list(rng.choice(family))
            for _ in range(rng.randrange(1, 1 + max(2, len(new) // 9))):
                at = rng.randrange(len(new))
                if rng.random() < 0.3 and len(new) > 8:
                    del new[at : at + 3]
                else:
                    new[at] = word()
            family.append(new)
        rows += family
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n in (2, 5):
        assert sorted(map(tuple, minhash.groups(docs, shingle=n).collect()), key=key) == brute_groups(rows, n)


def test_differences_lose_no_pair(spark):
    """All similar pairs around one centre come out of ``across``, whatever is linked."""
    rng = random.Random(12)
    base = list(range(60))
    sets = [set(base)]
    for _ in range(50):
        s = set(rng.choice(sets))
        for _ in range(rng.randrange(1, 9)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(1000, 1100))
        sets.append(s)
    similar = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    packed = [(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(packed, "doc bigint, set binary")
    groups = spark.createDataFrame([(0, i, len(s), similar(sets[0], s), i) for i, s in enumerate(sets) if i], "a bigint, b bigint, nb bigint, linked boolean, label bigint")
    found = {(r.a, r.b) for r in minhash.across(groups, frame, 80).collect()}
    away = [i for i in range(1, len(sets)) if not similar(sets[0], sets[i])]
    want = {(min(x, y), max(x, y)) for x in away for y in range(1, len(sets)) if x != y and similar(sets[x], sets[y])}
    assert want and want <= found


def test_densified_bins_estimate_similarity():
    rng = np.random.default_rng(5)
    oph = minhash.OnePermutation(128)
    for size in (8, 60, 1000):
        hits = []
        for _ in range(150):
            pool = np.unique(rng.integers(0, 2**63, size + size // 4).astype(np.uint64) * np.uint64(2))
            a, b = np.sort(pool[: size]), np.sort(rng.permutation(pool)[: size])
            s = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            hits.append((oph.of(a) == oph.of(b)).mean() - s)
        assert abs(np.mean(hits)) < 0.03


def test_lm_score(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    seen, out = {}, {}
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            for w in lm_score.split_words(r.text or "") + [b""]:
                seen[w] = seen.get(w, 0) + 1
    n, v = sum(seen.values()), len(seen)
    want = []
    for r in rows:
        ws = lm_score.split_words(r.text or "") + [b""]
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1
        want.append((r.doc_id, held, len(ws), sum(w in seen for w in ws), n, round(sum(math.log10((seen.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)))
    scores = []
    for size in (1 << 18, 4):  # with and without words beyond the table
        got = lm_score.score(odd, table_words=size).collect()
        assert sorted(((*tuple(r)[:5], round(r.base_score, 4)) for r in got), key=key) == sorted(want, key=key)
        assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm_score.score(none).count() == 0
    blind = lm_score.score(odd, held_out=F.lit(True)).collect()
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in blind)


def test_lm_gradients():
    """Backpropagation against differences."""
    vocab = lm_score.Vocabulary([b"", b"a", b"b"], np.array([5, 4, 3]), 12, 3, np.zeros(lm_score.BUCKETS), np.zeros(lm_score.BUCKETS))
    p = {k: v.astype(np.float64) for k, v in lm_score.initial(vocab).items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 80, (4, 3)), rng.integers(0, 80, (4, 3))
    h0 = np.zeros((3, lm_score.HIDDEN))

    def loss():
        s, _ = lm_score.output(p, lm_score.forward(p, x, h0).reshape(-1, lm_score.HIDDEN).astype(np.float64), y.reshape(-1))
        return -float(s.astype(np.float64).sum())

    kept, grads = [], {}
    states = lm_score.forward(p, x, h0, kept)
    _, dh = lm_score.output(p, states.reshape(-1, lm_score.HIDDEN), y.reshape(-1), grads)
    lm_score.backward(p, x, kept, dh.reshape(states.shape), grads)
    dense = np.zeros_like(p["E"])
    dense[grads.pop("E_rows")] = grads.pop("E")
    for name, g in [("E", dense), *grads.items()]:
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = p[name][at]
        p[name][at] = old + 3e-3
        up = loss()
        p[name][at] = old - 3e-3
        down = loss()
        p[name][at] = old
        assert (up - down) / 6e-3 == pytest.approx(g[at], rel=0.05, abs=0.02), name


def test_lm_learns(spark):
    """Held-out texts of a bigram language score better than under word counts."""
    rng = random.Random(4)
    after = {k: [rng.randrange(200) for _ in range(3)] for k in range(200)}

    def say():
        out = [rng.randrange(200)]
        for _ in range(rng.randrange(30, 90)):
            out.append(rng.choice(after[out[-1]]))
        return " ".join(f"w{x}" for x in out)

    docs = spark.createDataFrame([(i, say()) for i in range(1500)], "doc_id bigint, text string")
    got = lm_score.score(docs, share=1, rounds=2).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.1


def test_lm_learns_from_every_short_document(spark, monkeypatch):
    """By default every training token is learned from once, also of documents of one run, and word counts are beaten."""
    rng = random.Random(5)
    after = {k: [rng.randrange(200) for _ in range(3)] for k in range(200)}

    def say():
        out = [rng.randrange(200)]
        for _ in range(rng.randrange(30, 90)):
            out.append(rng.choice(after[out[-1]]))
        return " ".join(f"w{x}" for x in out)

    learned, summed = [], lm_score.summed

    def counted(parts):
        total = summed(parts)
        learned.append(total[-1])
        return total

    monkeypatch.setattr(lm_score, "summed", counted)
    docs = spark.createDataFrame([(i, say()) for i in range(1500)], "doc_id bigint, text string")
    got = lm_score.score(docs)
    total = got.agg(F.max("train_tokens")).first()[0]
    assert len(learned) == 3 and sum(learned) == total
    sums = got.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert sums[0] / sums[2] > sums[1] / sums[2] + 0.1


def test_lm_probabilities_sum_to_one():
    vocab = lm_score.Vocabulary([b"", b"a", b"b"], np.array([5, 4, 3]), 12, 3, np.zeros(lm_score.BUCKETS), np.zeros(lm_score.BUCKETS))
    p = lm_score.initial(vocab)
    h = np.random.default_rng(0).normal(0, 1, (1, lm_score.HIDDEN)).astype(np.float32)
    s, _ = lm_score.output(p, np.repeat(h, lm_score.TOKENS, axis=0), np.arange(lm_score.TOKENS))
    assert np.exp(s.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_repeated_rows_keep_the_callers_columns(odd, labels):
    rows = mixing.repeat_rows(odd).collect()
    assert rows and all(r[c] == "clash" for r in rows for c in CLASHES)
    kept = quality_rules.keep_rows(odd, labels).collect()
    assert kept and all(r[c] == "clash" for r in kept for c in CLASHES)


BROKEN = {
    "tags": "<a " * 333_000, "names": "<a" * 500_000, "quotes": '<a "' * 250_000, "late end": "<a " * 300_000 + '">', "joined": "<a<a" * 250_000 + ' ">',
    "blocks": "<div>" * 90_000 + "</p>" * 90_000, "items": "<x>" * 100_000 + "<li>" * 100_000, "mixed": "<a '<b \"<a " * 80_000 + ">", "comments": "<!-- " * 200_000,
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_pages_take_linear_time(kind):
    start = time.process_time()
    nodes = html_extract.parse(BROKEN[kind])
    assert nodes and time.process_time() - start < 10


def test_text_around_open_tags():
    texts = lambda page: "".join(t for n in html_extract.parse(page) for _, t in n.texts)
    assert texts('a <b c <p>x</p> d <i "e') == "a x d "
    assert texts("1 < 2 <p>3 <a href=\"x>y\">z</a> <b 'q") == "1 < 2 3 z "


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_wide_pieces(path):
    """Wide trees merge all places of one rank at a time, as one at a time would; a megabyte without a blank is quick."""
    rng = random.Random(1)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    texts = ["a" * n for n in (1023, 1024, 5000)] + ["ab" * 1000, "=" * 3000, "aab" * 700 + "z", "z" + "a" * 3333 + "t"]
    texts += [of(letters, 4000) for letters in ("abcde", "ab", "theinganr", "01", "=a-", "abcdefghijklmnopqrstuvwxyz", "éü日本")]
    for text in texts:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:30]
    start = time.process_time()
    own.encode([of("abcdefghijklmnopqrstuvwxyz", 1_000_000)])
    assert time.process_time() - start < 20


def test_contexts_that_tell_more_are_kept_at_any_size(spark):
    """The share rule keeps the same contexts when all rows stand there ten times."""
    rng = random.Random(2)
    urls = [(f"http://{'good' if i % 2 else 'bad'}.org/{''.join(rng.choice('abcd') for _ in range(6))}", i % 2 == 1) for i in range(300)]
    once = spark.createDataFrame(urls, "url string, accepted boolean")
    many = once.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("n")
    a, b = url_filter.fit(once), url_filter.fit(many)
    assert set(a.contexts) == set(b.contexts)
    assert all(c == "" or c[1:] in a.contexts for c in a.contexts)


def test_pipeline_stages(spark, odd, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, str(tmp_path)))
            assert name == "bpe_tokens" or out.columns == docs.columns
            if docs is odd and name in ("exact_dedup", "near_dedup"):
                assert out.count() < docs.count()
            if docs is none:
                assert out.count() == 0


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    library = Tokenizer.from_file(WORD_BPE)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = rows.collect()
    assert got
    for r in got[:40]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
