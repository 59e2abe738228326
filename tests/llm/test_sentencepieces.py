import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyline.llm import sentencepieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.load()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return P.Encoder(vocabulary)


def test_double_array_holds_just_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"\xe2\x96\x81x", b"zzz"]
    base, check, value = P.double_array([(k, i) for i, k in enumerate(keys)])

    def find(word):
        node = 0
        for c in word:
            t = base[node] + c + 1
            if t >= len(check) or check[t] != node:
                return -1
            node = t
        return value[node]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(w) == -1 for w in (b"c", b"ac", b"zz", b"abcd"))


def test_round_trip_of_any_text(encoder, plain):
    for text in ["", " ", "  two  spaces ", "▁ marks ▁▁", "tabs\t\nlines\r\n", "日本 ☃ 😀 \x00", *(t for _, t in plain)]:
        ids = encoder.encode(text)
        assert encoder.decode(ids.tolist()) == text
    assert len(encoder.encode(None)) == 0


def test_chunks_give_the_best_whole_segmentation(encoder, vocabulary, plain):
    score = lambda ids: sum(vocabulary.scores[i] if i not in set(vocabulary.byte_ids) else 0 for i in ids)
    for _, text in plain[:25]:
        text = text[:1500]
        whole = P.viterbi((P.MARK + text.replace(" ", P.MARK)).encode(), encoder.lists, encoder.score_list, encoder.unknown, encoder.byte_ids)
        parts = encoder.encode(text).tolist()
        assert abs(score(whole) - score(parts)) < 1e-6 and len(whole) == len(parts)


def test_segmentations_score_as_the_library_ones(encoder, vocabulary, plain):
    """The same pieces and scores given to the library as a unigram model."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(P.MODEL_PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        p.score = float(vocabulary.scores[i])
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = lambda ids: sum(vocabulary.scores[i] for i in ids)
    same = total = 0
    for _, text in plain[:60]:
        for line in text.split("\n")[:5]:
            ours, theirs = encoder.encode(line).tolist(), library.encode(line)
            assert abs(score(ours) - score(theirs)) < 1e-2
            same += ours == theirs
            total += 1
    assert same >= 0.9 * total  # the rest are ties that float32 sums break another way


def test_columns(spark, edge_docs, no_docs):
    rows = P.encode_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r["exact"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    back = edge_docs.select("text", P.decoded(P.encoded(F.col("text"), P.shared(spark))["ids"], P.shared(spark)).alias("back")).collect()
    assert all((r["text"] or "") == r["back"] for r in back)
    assert P.encode_documents(no_docs).count() == 0
