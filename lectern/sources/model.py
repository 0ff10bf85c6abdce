"""A dependency parser from a directory with `config.json`, `tokenizer.json` and `onnx/model.onnx`."""

from __future__ import annotations

import os
from functools import lru_cache
from pathlib import Path

import numpy as np

from lectern.functions.decoding import Labels, ModelError, decode, masked_rows, max_pieces

#: Rows of a sentence that go to the model at a time.
CHUNK = 16
INPUTS = ("input_ids", "attention_mask")


def check_graph(inputs: dict[str, str], outputs: dict[str, tuple[str, list]], labels: int) -> None:
    """Raises if the graph's inputs or logits aren't what the parser needs. inputs: type by name; outputs: (type, shape)."""
    for name in INPUTS:
        if name not in inputs:
            raise ModelError(f'the graph has no input "{name}"')
        if inputs[name] != "tensor(int64)":
            raise ModelError(f'the graph\'s input "{name}" is {inputs[name]}, not a tensor of i64')
    if other := next((n for n in inputs if n not in INPUTS), None):
        raise ModelError(f'the graph has an input "{other}" besides "input_ids" and "attention_mask"')
    if "logits" not in outputs:
        raise ModelError('the graph has no output "logits"')
    kind, shape = outputs["logits"]
    if kind != "tensor(float)":
        raise ModelError(f'the graph\'s output "logits" is {kind}, not a tensor of f32')
    if shape and isinstance(shape[-1], int) and shape[-1] >= 0 and shape[-1] != labels:
        raise ModelError(f'the graph\'s "logits" has {shape[-1]} values per piece, but there are {labels} labels')


class OnnxParser:
    def __init__(self, folder: str):
        path = Path(folder)
        for name in ("config.json", "tokenizer.json", "onnx/model.onnx"):
            if not (path / name).is_file():
                raise ModelError(f"cannot read {path / name}")
        config = (path / "config.json").read_text(encoding="utf-8")
        self.labels, self.most = Labels.from_config(config), max_pieces(config)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        try:
            self.tokenizer = Tokenizer.from_file(str(path / "tokenizer.json"))
        except Exception as e:
            raise ModelError(f"cannot read {path / 'tokenizer.json'}: {e}") from e
        self.special = []
        for t in ("<s>", "</s>", "<mask>"):
            if (i := self.tokenizer.token_to_id(t)) is None:
                raise ModelError(f'the tokenizer has no "{t}"')
            self.special.append(i)
        import onnxruntime

        self.session = onnxruntime.InferenceSession(str(path / "onnx/model.onnx"), providers=["CPUExecutionProvider"])
        check_graph({x.name: x.type for x in self.session.get_inputs()}, {x.name: (x.type, x.shape) for x in self.session.get_outputs()}, len(self.labels.names))

    def parse(self, sentence: str) -> dict:
        """{status: parsed | too_long, tokens, pieces, max}."""
        e = self.tokenizer.encode(sentence)
        found = [(i, o) for i, o in zip(e.ids, e.offsets, strict=True) if o[0] < o[1]]
        n = len(found)
        if n > self.most:
            return {"status": "too_long", "tokens": None, "pieces": n, "max": self.most}
        if not n:
            raise ValueError("the sentence has no subword pieces")
        ids = [i for i, _ in found]
        scores = []
        for at in range(0, n, CHUNK):
            rows = masked_rows(*self.special, ids, range(at, min(at + CHUNK, n)))
            (logits,) = self.session.run(["logits"], {"input_ids": rows, "attention_mask": np.ones_like(rows)})
            if logits.shape != (*rows.shape, len(self.labels.names)):
                raise ValueError(f"logits of shape {logits.shape}, expected {(*rows.shape, len(self.labels.names))}")
            scores.append(logits[:, 1 : n + 1])
        return {"status": "parsed", "tokens": decode(np.concatenate(scores), self.labels, sentence, [o for _, o in found]), "pieces": n, "max": self.most}


@lru_cache(1)
def load(folder: str) -> OnnxParser:
    """The parser, once in each worker."""
    return OnnxParser(folder)
