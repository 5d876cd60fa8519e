"""A tiny ONNX sentence encoder written as raw protobuf (the ``onnx`` package is
not installed): embedding lookup + attention-masked mean pooling, output
``embeddings`` [batch, dim]. Test helper only."""

from __future__ import annotations


import numpy as np


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        b = n & 0x7F
        n >>= 7
        out.append(b | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _key(field: int, wire: int) -> bytes:
    return _varint((field << 3) | wire)


def f_int(field: int, v: int) -> bytes:
    return _key(field, 0) + _varint(v)


def f_bytes(field: int, v: bytes | str) -> bytes:
    b = v.encode() if isinstance(v, str) else v
    return _key(field, 2) + _varint(len(b)) + b


def attr_ints(name: str, values) -> bytes:
    return f_bytes(1, name) + b"".join(f_int(8, v) for v in values) + f_int(20, 7)


def attr_int(name: str, v: int) -> bytes:
    return f_bytes(1, name) + f_int(3, v) + f_int(20, 2)


def node(op: str, inputs, outputs, attrs=()) -> bytes:
    return (b"".join(f_bytes(1, i) for i in inputs) + b"".join(f_bytes(2, o) for o in outputs)
            + f_bytes(4, op) + b"".join(f_bytes(5, a) for a in attrs))


def value_info(name: str, elem_type: int, dims) -> bytes:
    shape = b"".join(f_bytes(1, f_bytes(2, d) if isinstance(d, str) else f_int(1, d)) for d in dims)
    tensor = f_int(1, elem_type) + f_bytes(2, shape)
    return f_bytes(1, name) + f_bytes(2, f_bytes(1, tensor))


def tensor(name: str, arr: np.ndarray) -> bytes:
    a = np.ascontiguousarray(arr, dtype=np.float32)
    return b"".join(f_int(1, d) for d in a.shape) + f_int(2, 1) + f_bytes(8, name) + f_bytes(9, a.tobytes())


def mean_pool_encoder(table: np.ndarray) -> bytes:
    FLOAT, INT64 = 1, 7
    nodes = [
        node("Gather", ["table", "input_ids"], ["tok"]),
        node("Cast", ["attention_mask"], ["maskf"], [attr_int("to", FLOAT)]),
        node("Unsqueeze", ["maskf"], ["mask3"], [attr_ints("axes", [2])]),
        node("Mul", ["tok", "mask3"], ["masked"]),
        node("ReduceSum", ["masked"], ["summed"], [attr_ints("axes", [1]), attr_int("keepdims", 0)]),
        node("ReduceSum", ["maskf"], ["count"], [attr_ints("axes", [1]), attr_int("keepdims", 1)]),
        node("Max", ["count", "eps"], ["denom"]),
        node("Div", ["summed", "denom"], ["embeddings"]),
    ]
    graph = (b"".join(f_bytes(1, n) for n in nodes) + f_bytes(2, "pool")
             + f_bytes(5, tensor("table", table)) + f_bytes(5, tensor("eps", np.array([1e-9], np.float32)))
             + f_bytes(11, value_info("input_ids", INT64, ["batch", "seq"]))
             + f_bytes(11, value_info("attention_mask", INT64, ["batch", "seq"]))
             + f_bytes(12, value_info("embeddings", FLOAT, ["batch", table.shape[1]])))
    opset = f_bytes(1, "") + f_int(2, 11)
    return f_int(1, 7) + f_bytes(2, "mailsift-test") + f_bytes(7, graph) + f_bytes(8, opset)


