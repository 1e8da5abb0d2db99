"""A bidirectional LSTM tagger as an ONNX model, written byte by byte (the onnx package is not needed to run one).

Numbers of fields and kinds are those of the public ONNX protocol buffer definition.
"""

from __future__ import annotations

import numpy as np

_FLOAT, _INT32, _INT64 = 1, 6, 7


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _constant(name: str, array: np.ndarray) -> bytes:
    array = np.ascontiguousarray(array)
    kind = _INT64 if array.dtype == np.int64 else _FLOAT
    return _bytes(5, b"".join(_number(1, d) for d in array.shape) + _number(2, kind) + _bytes(8, name) + _bytes(9, array.tobytes()))


def _attribute(name: str, value: int | str | list[int]) -> bytes:
    if isinstance(value, int):
        return _bytes(5, _bytes(1, name) + _number(3, value) + _number(20, 2))
    if isinstance(value, str):
        return _bytes(5, _bytes(1, name) + _bytes(4, value) + _number(20, 3))
    return _bytes(5, _bytes(1, name) + b"".join(_number(8, x) for x in value) + _number(20, 7))


def _node(op: str, inputs: list[str], output: str, **attributes) -> bytes:
    return _bytes(1, b"".join(_bytes(1, i) for i in inputs) + _bytes(2, output) + _bytes(4, op) + b"".join(_attribute(k, v) for k, v in attributes.items()))


def _value(field: int, name: str, kind: int, dims: str) -> bytes:
    shape = b"".join(_bytes(1, _bytes(2, d)) for d in dims)
    return _bytes(field, _bytes(1, name) + _bytes(2, _bytes(1, _number(1, kind) + _bytes(2, shape))))


def tagger(w: dict[str, np.ndarray]) -> bytes:
    """The model of pii.Model: bucket and class [time, lane] and length [lane], all int32, to scores [time, tag, lane]."""
    n = w["fw_h"].shape[0]
    gates = np.concatenate([np.arange(g * n, (g + 1) * n) for g in (0, 2, 1, 3)])  # input, output, forget, cell
    both = lambda f: np.stack([f(d) for d in ("fw", "bw")]).astype(np.float32)
    constants = {
        "chars": w["chars"], "kinds": w["kinds"], "W": both(lambda d: np.concatenate([w[f"{d}_c"], w[f"{d}_k"]])[:, gates].T), "R": both(lambda d: w[f"{d}_h"][:, gates].T),
        "B": both(lambda d: np.concatenate([w[f"{d}_b"][gates], np.zeros(4 * n)])), "out": w["out"], "out_b": w["out_b"],
    }
    nodes = (
        _node("Gather", ["chars", "bucket"], "c") + _node("Gather", ["kinds", "class"], "k") + _node("Concat", ["c", "k"], "x", axis=2)
        + _node("LSTM", ["x", "W", "R", "B", "length"], "y", hidden_size=n, direction="bidirectional")
        + _node("Transpose", ["y"], "turned", perm=[0, 2, 1, 3]) + _node("Reshape", ["turned", "flat"], "h") + _node("MatMul", ["h", "out"], "m") + _node("Add", ["m", "out_b"], "s")
        + _node("Transpose", ["s"], "scores", perm=[0, 2, 1])
    )
    held = b"".join(_constant(k, v.astype(np.float32)) for k, v in constants.items()) + _constant("flat", np.array([0, 0, 2 * n], np.int64))
    ends = _value(11, "bucket", _INT32, "tb") + _value(11, "class", _INT32, "tb") + _value(11, "length", _INT32, "b") + _value(12, "scores", _FLOAT, "tkb")
    return _number(1, 8) + _bytes(8, _bytes(1, "") + _number(2, 14)) + _bytes(7, nodes + _bytes(2, "tagger") + held + ends)
