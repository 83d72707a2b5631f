"""Cases in which an operator once did less than the whole job."""

import random

import public_tokenizers
import pytest

from auditframe.llm import piece_dropout, simhash_anchor, url_equivalence
from auditframe.llm.queries import URL_RULES


def test_every_occurrence_draws_its_own_skips():
    model = piece_dropout.Pieces(public_tokenizers.path(piece_dropout.MODEL))
    word = "internationalization"
    undropped, found = tuple(model.encode(word)), []
    for key in range(300):
        ids = tuple(model.encode(word, 0.1, 1, key))
        assert model.decode(list(ids)) == word and ids == tuple(model.encode(word, 0.1, 1, key))
        found.append(ids)
    assert len(set(found)) > 10 and undropped in found
    merges = []
    model.segment(" " + word, trace=merges)
    # Nothing is skipped in as many occurrences as the rate says; other merges may lead to the same ids.
    assert 0.9 ** len(merges) - 0.1 < found.count(undropped) / 300 < 0.9
    # Occurrences in one text differ too, and long texts and parts follow the agenda with the same hash.
    assert len({tuple(model.encode(" ".join([word] * n), 0.1, 1, 1)[-12:]) for n in range(1, 60)}) > 4
    text = f"{word} {'é' * 10} {'a' * 300} x\n" * 40
    parts = [p for s in piece_dropout._STRETCH.findall(" " + text) for p in model._split(s)]
    keys = piece_dropout._keys([piece_dropout.xxhash.xxh64_intdigest("5/7")], [(0, 0, len(parts))])
    want = [i for p, k in zip(parts, keys) for i in model._long(p, int(0.3 * 2**32), int(k), (), [])]
    assert model.encode(text, 0.3, 5, 7) == want


def test_parts_share_the_rounds_of_their_agendas(monkeypatch):
    """New words do not run an agenda each; with the time of one for every new word or skip the operator failed its budget."""
    rng = random.Random(3)
    model = piece_dropout.Pieces(public_tokenizers.path(piece_dropout.MODEL))
    texts = [" ".join("".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 16))) for _ in range(400)) for _ in range(5)]
    want = [agenda_ids(model, t, 0.1, 1, k) for k, t in enumerate(texts)]
    alone = []
    for name in ("segment", "_short", "_long", "_agenda"):
        monkeypatch.setattr(model, name, lambda *a, **b: alone.append(a) or (), raising=False)
    got = [list(ids) for ids in model.encode_all(texts, 0.1, 1, [*range(5)])]
    assert not alone and got == want


def agenda_ids(model, text, dropout, seed, key):
    """Ids by the agenda of each part alone."""
    parts = [p for s in piece_dropout._STRETCH.findall(" " + text) for p in model._split(s)] if text else []
    keys = piece_dropout._keys([piece_dropout.xxhash.xxh64_intdigest(f"{seed}/{key}")], [(0, 0, len(parts))])
    return [i for p, k in zip(parts, keys) for i in model._long(p, int(dropout * 2**32), int(k), (), [])]


@pytest.mark.parametrize(("block", "short", "together"), [(1, 32, 32), (50, 2, 1), (1000, 4, 3), (1 << 17, 32, 32), (1 << 17, 2, 1 << 30)])
def test_blocks_and_rounds_give_what_the_agenda_gives(monkeypatch, block, short, together):
    for name, value in (("BLOCK", block), ("SHORT", short), ("TOGETHER", together)):
        monkeypatch.setattr(piece_dropout, name, value)
    rng = random.Random(5)
    letters = [*"abcXYZ019.,!-_' \n\t▁éŒ日ж\U0001f642\x00\x1c\U0010ffff", "  ", "the", "tion", " \n", "\r\n", "▁▁", "a" * 40]
    texts = [None, "", " ", "\n", "a" * 1500 + " " + "x" * 70, *("".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 20, 200]))) for _ in range(60)), None]
    model = piece_dropout.Pieces(public_tokenizers.path(piece_dropout.MODEL))
    for dropout in (0.0, 0.1, 0.6):
        got = [list(ids) for ids in model.encode_all(texts, dropout, 5, [*range(len(texts))])]
        assert got == [agenda_ids(model, t, dropout, 5, k) for k, t in enumerate(texts)]
        assert [model.decode(ids) for ids in got] == [t or "" for t in texts]


def test_null_ids_are_told_apart_by_text(spark):
    word = "internationalization"
    docs = spark.createDataFrame([(None, f"{word} {i}") for i in range(60)] + [(1, word), (1, word)], "doc_id bigint, text string")
    rows = piece_dropout.encode(docs).collect()
    assert len({tuple(r["ids"][:3]) for r in rows if r["doc_id"] is None}) > 4
    assert len({tuple(r["ids"]) for r in rows if r["doc_id"] == 1}) == 1


def test_links_of_every_form_carry_verdicts(spark):
    blocked, long = "http://b.net/fr/1", "x" * 500
    links = [
        f'<link href="{blocked}" rel="canonical">', f'<link rel="canonical" data-a="{long}" href="{blocked}">', f"<link rel=canonical href={blocked}>",
        f"<link title='a > b, rel=x' href='{blocked}' rel='alternate Canonical' />", f'<meta content="0; url={blocked}" http-equiv="refresh">',
        f"<meta http-equiv='refresh' data-a='{long}' content='0;URL=\"{blocked}\"'>", f'<link rel="canonical" href="http://o.org/"><link rel="canonical" href="{blocked}">',
        f'<base href="http://b.net/fr/x/">\n<link\nrel="canonical"\nhref="../1">']
    rows = [(i, f"http://a{i}.org/p", h) for i, h in enumerate(links)]
    rows += [(90, "http://a90.org/", f'<link title="rel=canonical" href="{blocked}">'), (91, "http://a91.org/", f'<meta name="refresh" content="0; url={blocked}">'),
             (92, "nourl", '<link rel="canonical" href="x">'), (93, None, links[0])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    verdict = {r["page_id"]: r["verdict"] for r in url_equivalence.judge(pages, URL_RULES).collect()}
    assert verdict == {**{i: "block" for i in range(len(links))}, 90: "allow", 91: "allow", 92: "allow", 93: "allow"}


def test_relative_targets_resolve_against_the_page(spark):
    page = "http://A.org/d/e/f.php?q=1"
    want = {
        "g.php": "http://a.org/d/e/g.php", "../x": "http://a.org/d/x", "../../../x": "http://a.org/x", "./": "http://a.org/d/e/", "..": "http://a.org/d/",
        "?id=1": "http://a.org/d/e/f.php?id=1", "/z/../y?a=../b": "http://a.org/y?a=../b", "//h.org/i": "http://h.org/i", "g?u=http://x.org": "http://a.org/d/e/g?u=http://x.org",
        "HTTPS://k.org/": "HTTPS://k.org/", "": None, "#top": None, "mailto:a@b": None}
    rows = spark.createDataFrame(list({k: page for k in want}.items()), "found string, url string")
    got = rows.select("found", url_equivalence._target(rows["url"], rows["found"]).alias("to")).collect()
    assert {r["found"]: r["to"] for r in got} == want
    bare = spark.createDataFrame([("http://a.org", "x")], "url string, found string")
    assert bare.select(url_equivalence._target(bare["url"], bare["found"])).collect()[0][0] == "http://a.org/x"


def test_null_and_repeated_ids_keep_one_row_a_component(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(6)]
    rows = [(None, texts[0], "a"), (None, texts[0], "b"), (None, texts[1], None), (None, texts[2], "a"), (None, texts[2], "a"),
            (7, texts[3], "a"), (7, texts[4], "a"), (8, texts[4], "a"), (9, texts[5], "a"), (None, texts[5], "a"), (7, texts[4], "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    kept = simhash_anchor.keep_one(docs)
    got = kept.collect()
    assert kept.columns == docs.columns
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5])]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)
