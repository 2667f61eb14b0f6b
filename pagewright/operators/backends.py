"""Models: ONNX files or callables from a float32 tensor to an array. A worker loads each once."""

from __future__ import annotations

import hashlib

_sessions: dict[str, object] = {}


class Onnx:
    """Runs a model's bytes, broadcast to the workers; its first output is returned."""

    def __init__(self, spark, path: str):
        from pagewright.sources.images import resolve

        rows = spark.read.format("binaryFile").load(resolve(path)).select("content").collect()  # one model file
        if len(rows) != 1:
            raise FileNotFoundError(path)
        content = bytes(rows[0]["content"])
        self.key = hashlib.sha256(content).hexdigest()
        self.sent = spark.sparkContext.broadcast(content)

    def __call__(self, tensor):
        if self.key not in _sessions:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1  # tasks are the parallelism
            _sessions[self.key] = onnxruntime.InferenceSession(self.sent.value, options, providers=["CPUExecutionProvider"])
        session = _sessions[self.key]
        return session.run(None, {session.get_inputs()[0].name: tensor})[0]

    def release(self) -> None:
        self.sent.unpersist()


def backend(spark, model):
    """A callable stays itself; a path becomes an Onnx model."""
    return model if callable(model) else Onnx(spark, model)
