import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from conftest import HARD  # noqa: F401

from orelode.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def raw():
    return pieces.read_model(PATH)


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(" \n\t▁abethin<s>/é漢\U0001f600\x00́.,0129  ") for _ in range(r.randint(0, 40))) for _ in range(n)] + ["<s>", "</s>", "<unk>", "<0x0A>", " ", "\n", "▁", "  a", "a  ", "\r\n", "the quick brown fox"]


def test_counts_are_the_librarys(raw):
    model, cache = pieces._worker(raw, pieces._Counts)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in odd_texts(3000, 1):
        assert (sum(map(cache.__getitem__, model.chunks(pieces.SPACE + t.replace(" ", pieces.SPACE)))) if t else 0) == len(library.encode(t)), t


def test_viterbi_is_the_best_path_and_decodes_exactly(raw):
    model, cache = pieces._worker(raw, pieces._Encoded)
    decoder, names = pieces.Decoder(model), {v: k for k, v in model.ids.items()}

    def best(chunk):
        top = [0.0] + [float("-inf")] * len(chunk)
        for j in range(1, len(chunk) + 1):
            for i in range(max(0, j - 20), j):
                s = model.scores.get(chunk[i:j], cache.unknown if j == i + 1 and chunk[i] not in model.singles else float("-inf"))
                top[j] = max(top[j], top[i] + s)
        return top[-1]

    for t in odd_texts(400, 2):
        ids = pieces.encode_text(t, cache, model.chunks)
        assert decoder.text(ids) == t
        if pieces.SPACE not in t and t:
            for chunk in model.chunks(pieces.SPACE + t.replace(" ", pieces.SPACE)):
                path = pieces._segments(chunk, cache.automaton, model.singles, cache.unknown)
                assert abs(sum(model.scores[names[n]] if n >= 0 else cache.unknown for _, n in path) - best(chunk)) < 1e-6 * abs(best(chunk))


def test_hard_rows(table, raw):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in HARD)
    got = pieces.token_counts(table(HARD), raw).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    trip = pieces.round_trip(table(HARD), raw).collect()
    assert all(r.exact for r in trip)
    assert sorted(r.decoded_sha256 for r in trip) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in HARD)
    both = pieces.decode(pieces.encode(table(HARD[:7]), raw), raw).collect()
    assert sorted(r.text for r in both) == sorted(t or "" for _, t in HARD[:7])
    assert pieces.token_counts(table([]), raw).count() == pieces.round_trip(table([]), raw).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(b"")
