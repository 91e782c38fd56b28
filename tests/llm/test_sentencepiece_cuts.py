"""Where texts are cut, what the table of segments keeps, and the table of pairs, against the library."""

import io
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from millrace.llm import sentencepiece_bpe


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("aeiourstnlé") for _ in range(rng.randint(5, 12))) for _ in range(n)]


def test_words_before_signs_are_merged_once(lib):
    """No piece holds a letter and one of these signs, so a word is one segment, whatever sign follows."""
    pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
    signs = [s for s in "&$%#*^~漢" if not any(s in p and len(p) > 1 and any(c.isalpha() for c in p[: p.index(s)]) for p in pieces)]
    assert len(signs) > 4
    words = _words(300, 1)
    texts = [w + s for w in words for s in signs]
    agenda = sentencepiece_bpe.Agenda(lib)
    assert agenda.encode(texts) == lib.encode(texts)
    assert len(agenda.rows) < 2 * len(words)


def test_frequent_segments_outlive_a_full_table(lib):
    """Words that come in every call are merged once, though others fill the table again and again."""
    agenda, merged = sentencepiece_bpe.Agenda(lib, cache=500), []
    learn = agenda.learn
    agenda.learn = lambda segments: (merged.extend(segments), learn(segments))
    often = _words(40, 2)
    agenda.encode([" ".join(often)])
    first = list(merged)
    for call in range(30):
        text = " ".join(often + _words(60, 100 + call))
        assert agenda.encode([text]) == [lib.encode(text)]
        assert len(agenda.rows) <= 501
    assert len(first) >= len(often) and all(merged.count(x) == 1 for x in first)


def test_more_segments_than_the_table_holds(lib):
    words = _words(3000, 3)
    agenda = sentencepiece_bpe.Agenda(lib, cache=300)
    for _ in range(3):
        assert agenda.encode([" ".join(words[:200]), "", " ".join(words)]) == lib.encode([" ".join(words[:200]), "", " ".join(words)])


def test_any_code_points(lib):
    """Texts of signs from everywhere, of every length around that of short segments."""
    rng = random.Random(4)
    plain = [chr(c) for c in range(1, 0x250)] + ["▁", " ", "\n"] * 20
    far = [chr(rng.choice([rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(400)]
    texts = ["".join(rng.choice(plain if rng.random() < 0.9 else far) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [letter * n for letter in ("a", "l", "-", "=", "!", " ", "▁", "漢", "\x00") for n in range(50)]
    agenda = sentencepiece_bpe.Agenda(lib)
    assert agenda.encode(texts) == lib.encode(texts)
    assert agenda.encode(["", "", ""]) == [[], [], []] and agenda.encode([]) == []


def test_cut_in_stretches(lib, monkeypatch):
    """The border of a stretch of code points is no cut, and hides none."""
    texts = ["the&&people, and their re-election. ", "Ünïted\nstates"] * 20
    whole = sentencepiece_bpe.Agenda(lib)
    found = whole.encode(texts)
    for stretch in (1, 2, 7):
        monkeypatch.setattr(sentencepiece_bpe, "STRETCH", stretch)
        parts = sentencepiece_bpe.Agenda(lib)
        assert parts.encode(texts) == found == lib.encode(texts) and parts.rows == whole.rows


def test_pairs_are_those_of_the_vocabulary(lib):
    agenda = sentencepiece_bpe.Agenda(lib)
    known = {}
    for piece, i in agenda.ids.items():
        for at in range(1, len(piece)):
            if all(len(x) == 1 or x in agenda.ids for x in (piece[:at], piece[at:])):
                known[agenda._symbol(piece[:at]), agenda._symbol(piece[at:])] = i
    rng = random.Random(5)
    some = list(known)
    asked = some + [(rng.choice(some)[0], rng.choice(some)[1]) for _ in range(50_000)] + [(-1, 5), (5, -1), (-1, -1)]
    ranks, ids = agenda._look(*(np.array(x, np.int32) for x in zip(*asked, strict=True)))
    assert [int(i) if r != sentencepiece_bpe.NEVER else None for r, i in zip(ranks, ids, strict=True)] == [known.get(x) for x in asked]


def test_pieces_that_reach_across_spaces():
    """Such a vocabulary is not cut at every mark; before, it was refused."""
    model = io.BytesIO()
    lines = ["of the people by the people for the people", "in the end of the day", "to be or not to be"] * 30
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_writer=model, model_type="bpe", vocab_size=330, byte_fallback=True, split_by_whitespace=False,
        normalization_rule_name="identity", remove_extra_whitespaces=False, hard_vocab_limit=False, minloglevel=2,
    )
    small = sentencepiece.SentencePieceProcessor(model_proto=model.getvalue())
    assert any("▁" in small.id_to_piece(i)[1:] for i in range(small.get_piece_size()))
    texts = [*lines[:3], "of the the people  in the", "be or not 漢 to be", "", " "]
    assert sentencepiece_bpe.Agenda(small).encode(texts) == small.encode(texts)
