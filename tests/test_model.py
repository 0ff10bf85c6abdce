"""The parser over a tiny ONNX graph written by hand: logits are a table's rows by token id."""

import json

import numpy as np
import pytest

from lectern.functions import trees
from lectern.functions.decoding import ModelError
from lectern.sources import model

LABELS = ["X|_|X", "X|_|goeswith", "VERB|_|root", "NOUN|_|nsubj", "NOUN|_|obj", "PUNCT|_|punct"]
WORDS = ["<s>", "</s>", "<mask>", "<unk>", "dogs", "chase", "cats", "."]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def number(field, n):
    return varint(field << 3) + varint(n)


def data(field, b):
    b = b.encode() if isinstance(b, str) else b
    return varint(field << 3 | 2) + varint(len(b)) + b


def value(name, kind, dims):
    shape = b"".join(data(1, data(2, d) if isinstance(d, str) else number(1, d)) for d in dims)
    return data(1, name) + data(2, data(1, number(1, kind) + data(2, shape)))


def graph(table, inputs=(("input_ids", 7), ("attention_mask", 7)), output="logits"):
    node = data(1, "table") + data(1, "input_ids") + data(2, output) + data(4, "Gather")
    weights = number(1, table.shape[0]) + number(1, table.shape[1]) + number(2, 1) + data(8, "table") + data(9, table.astype("<f4").tobytes())
    g = data(1, node) + data(2, "g") + data(5, weights) + b"".join(data(11, value(n, k, ("rows", "width"))) for n, k in inputs) + data(12, value(output, 1, ("rows", "width", table.shape[1])))
    return number(1, 8) + data(7, g) + data(8, number(2, 13))


def write(folder, table=None, labels=LABELS, positions=20, **kw):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    (folder / "onnx").mkdir(parents=True)
    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="<unk>"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.post_processor = processors.TemplateProcessing(single="<s> $A </s>", special_tokens=[("<s>", 0), ("</s>", 1)])
    t.save(str(folder / "tokenizer.json"))
    (folder / "config.json").write_text(json.dumps({"id2label": {str(i): n for i, n in enumerate(labels)}, "max_position_embeddings": positions, "pad_token_id": 1}))
    if table is None:
        table = np.full((len(WORDS), len(LABELS)), -5.0)
        table[4, 3] = table[6, 4] = table[7, 5] = 5
        table[2, 2] = 1
    (folder / "onnx/model.onnx").write_bytes(graph(table, **kw))
    return str(folder)


def test_parse(tmp_path):
    p = model.OnnxParser(write(tmp_path / "m"))
    out = p.parse("dogs chase cats .")
    assert out["status"] == "parsed" and trees.tree_error(out["tokens"]) is None
    assert [t["form"] for t in out["tokens"]] == ["dogs", "chase", "cats", "."]
    assert sum(t["head"] == 0 and t["deprel"] == "root" for t in out["tokens"]) == 1
    assert p.most == 15 and p.parse(" ".join(["dogs"] * 16)) == {"status": "too_long", "tokens": None, "pieces": 16, "max": 15}
    assert p.parse("dogs " * 15)["status"] == "parsed"


def test_offsets_are_characters(tmp_path):
    p = model.OnnxParser(write(tmp_path / "m"))
    assert [t["form"] for t in p.parse("é漢 dogs 😀 cats")["tokens"]] == ["é漢", "dogs", "😀", "cats"]


def test_causes_are_named(tmp_path):
    with pytest.raises(ModelError, match="config.json"):
        model.OnnxParser(str(tmp_path / "none"))
    with pytest.raises(ModelError, match="root"):
        model.OnnxParser(write(tmp_path / "a", labels=["X|_|X", "X|_|goeswith", "VERB|_|x"]))
    with pytest.raises(ModelError, match="max_position"):
        model.OnnxParser(write(tmp_path / "b", positions=4))
    with pytest.raises(ModelError, match="logits"):
        model.OnnxParser(write(tmp_path / "c", output="scores"))
    with pytest.raises(ModelError, match="besides"):
        model.OnnxParser(write(tmp_path / "d", inputs=(("input_ids", 7), ("attention_mask", 7), ("more", 7))))
    folder = write(tmp_path / "e")
    (tmp_path / "e/tokenizer.json").write_text("{")
    with pytest.raises(ModelError, match="tokenizer.json"):
        model.OnnxParser(folder)


def test_command_line_with_a_model(spark, tmp_path):
    import io

    from lectern import cli

    folder = write(tmp_path / "m")
    (tmp_path / "a.txt").write_text("dogs chase cats. cats chase dogs.\n")
    out, err = io.StringIO(), io.StringIO()
    assert cli.main(["analyze", str(tmp_path / "a.txt"), "--model-path", folder], spark, out, err) == 0
    assert "absent" not in out.getvalue().split("mean dependency distance")[1].split("\n")[0] and "passive voice             0" in out.getvalue()
    (tmp_path / "b.txt").write_text(" ".join(["dogs"] * 40) + ".\n")
    out, err = io.StringIO(), io.StringIO()
    assert cli.main(["check", str(tmp_path / "b.txt"), "--model-path", folder, "--format", "compact"], spark, out, err) == 1
    assert "sentence too long for the model (41 subword pieces, max 15)" in err.getvalue() and "LongSentence" in out.getvalue()
