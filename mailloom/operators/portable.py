"""Trained heads as ONNX files, and scoring with such files.

The files are written as protocol-buffer messages by hand, since the format's own library is
not needed for four kinds of nodes; field numbers are the format's.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.sources.shared import new_path

OPSET, ML_OPSET, IR = 14, 3, 8
FLOAT, INT64 = 1, 7
_ATTRIBUTE = {"ints": (8, 7), "floats": (7, 6), "strings": (9, 8), "string": (4, 3), "int": (3, 2)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, x: np.ndarray) -> bytes:
    dims = b"".join(_number(1, n) for n in x.shape)
    kind, form = (INT64, "<i8") if x.dtype.kind == "i" else (FLOAT, "<f4")
    return dims + _number(2, kind) + _bytes(8, name) + _bytes(9, np.ascontiguousarray(x, form).tobytes())


def _value(name: str, kind: int, dims: list[int | str]) -> bytes:
    shape = b"".join(_bytes(1, _bytes(2, d) if isinstance(d, str) else _number(1, d)) for d in dims)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, kind) + _bytes(2, shape)))


def _attribute(name: str, kind: str, value) -> bytes:
    field, code = _ATTRIBUTE[kind]
    if kind == "ints":
        data = b"".join(_number(field, v) for v in value)
    elif kind == "floats":
        data = b"".join(_varint(field << 3 | 5) + struct.pack("<f", v) for v in value)
    elif kind == "strings":
        data = b"".join(_bytes(field, v) for v in value)
    else:
        data = _bytes(field, value) if kind == "string" else _number(field, value)
    return _bytes(1, name) + data + _number(20, code)


def _node(op: str, inputs: list[str], outputs: list[str], domain: str = "", attributes: tuple[bytes, ...] = ()) -> bytes:
    return b"".join([*(_bytes(1, x) for x in inputs), *(_bytes(2, x) for x in outputs), _bytes(4, op), *(_bytes(5, a) for a in attributes), _bytes(7, domain) if domain else b""])


def _model(nodes: list[bytes], weights: dict[str, np.ndarray], n_features: int, n_classes: int) -> bytes:
    graph = b"".join([*(_bytes(1, n) for n in nodes), _bytes(2, "head"), *(_bytes(5, _tensor(k, v)) for k, v in weights.items()), _bytes(11, _value("features", FLOAT, ["n", n_features])), _bytes(12, _value("probabilities", FLOAT, ["n", n_classes]))])
    opsets = _bytes(8, _number(2, OPSET)) + _bytes(8, _bytes(1, "ai.onnx.ml") + _number(2, ML_OPSET))
    return _number(1, IR) + _bytes(2, "mailloom") + _bytes(7, graph) + opsets


def _dense(layers: list[tuple[np.ndarray, np.ndarray]], hidden: str = "Sigmoid") -> bytes:
    """A chain of layers (weights [in, out], offsets), softmax at the end."""
    nodes, weights, at = [], {}, "features"
    for k, (w, b) in enumerate(layers):
        weights |= {f"w{k}": w, f"b{k}": b}
        nodes += [_node("MatMul", [at, f"w{k}"], [f"m{k}"]), _node("Add", [f"m{k}", f"b{k}"], [f"s{k}"])]
        last = k == len(layers) - 1
        at = "probabilities" if last else f"h{k}"
        nodes.append(_node("Softmax", [f"s{k}"], [at], attributes=(_attribute("axis", "int", -1),)) if last else _node(hidden, [f"s{k}"], [at]))
    return _model(nodes, weights, layers[0][0].shape[0], layers[-1][0].shape[1])


def _border(x: float) -> float:
    """The largest single that isn't above a double: singles lie on the same side of both."""
    y = np.float32(x)
    return float(np.nextafter(y, np.float32(-np.inf)) if y > x else y)


def _saved_nodes(model) -> pa.Table:
    """The node table that a forest of Spark's is saved as: a model's size, one trip to the driver. Needs the shared folder on a cluster."""
    spark = SparkSession.getActiveSession()
    path = new_path(spark, "forest")
    model.write().save(path)
    found = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").toArrow()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return found


def _forest(model) -> bytes:
    """Trees of node arrays; a leaf's votes are its class shares, divided by the number of trees."""
    if type(model).__name__ == "ForestModel":
        tree, node, feature, value, left, right, counts = model.nodes()
        leaf = left < 0
        stats, values = counts[leaf].astype(float), [_border(x) for x in value.tolist()]
    else:
        t = _saved_nodes(model)
        column = lambda c: t.column(c).to_numpy()
        tree, node, left, right = (column(c) for c in ("treeID", "id", "leftChild", "rightChild"))
        split = t.column("split").combine_chunks()
        feature, kinds, borders = split.field("featureIndex").to_numpy(), split.field("numCategories").to_numpy(), split.field("leftCategoriesOrThreshold").to_pylist()
        leaf = left < 0
        if (kinds[~leaf] >= 0).any():
            raise ValueError("a forest with categories has no portable form")
        stats = np.array(t.column("impurityStats").to_pylist(), float)[leaf]
        values = [0.0 if x else _border(b[0]) for x, b in zip(leaf, borders, strict=True)]
    zero = lambda v: np.where(leaf, 0, v).tolist()
    votes, classes = stats / stats.sum(1, keepdims=True) / model.getNumTrees, model.numClasses
    attributes = [
        _attribute("nodes_treeids", "ints", tree.tolist()), _attribute("nodes_nodeids", "ints", node.tolist()), _attribute("nodes_featureids", "ints", zero(feature)),
        _attribute("nodes_truenodeids", "ints", zero(left)), _attribute("nodes_falsenodeids", "ints", zero(right)),
        _attribute("nodes_values", "floats", values), _attribute("nodes_modes", "strings", np.where(leaf, "LEAF", "BRANCH_LEQ").tolist()),
        _attribute("class_treeids", "ints", np.repeat(tree[leaf], classes).tolist()), _attribute("class_nodeids", "ints", np.repeat(node[leaf], classes).tolist()),
        _attribute("class_ids", "ints", np.tile(np.arange(classes), len(votes)).tolist()), _attribute("class_weights", "floats", votes.ravel().tolist()),
        _attribute("classlabels_int64s", "ints", list(range(classes))), _attribute("post_transform", "string", "NONE"),
    ]
    return _model([_node("TreeEnsembleClassifier", ["features"], ["class", "probabilities"], "ai.onnx.ml", tuple(attributes))], {}, model.numFeatures, classes)


def _boosted(model) -> bytes:
    """One tree for each round and class; a leaf gives its value to its class, and the softmax is over the sums."""
    a = model.arrays
    feature, border, value = a["feature"], a["border"], a["value"]
    n = {k: [] for k in ("nodes_treeids", "nodes_nodeids", "nodes_featureids", "nodes_truenodeids", "nodes_falsenodeids", "class_treeids", "class_nodeids", "class_ids")}
    values, modes, votes = [], [], []
    for tree, (t, c) in enumerate(np.ndindex(feature.shape[:2])):
        todo = [0]
        while todo:
            node = todo.pop()
            f, inner = int(feature[t, c, node]), feature[t, c, node] >= 0
            children = (2 * node + 1, 2 * node + 2) if inner else (0, 0)
            for k, x in zip(("nodes_treeids", "nodes_nodeids", "nodes_featureids", "nodes_truenodeids", "nodes_falsenodeids"), (tree, node, max(f, 0), *children), strict=True):
                n[k].append(x)
            modes.append("BRANCH_LEQ" if inner else "LEAF")
            values.append(_border(border[t, c, node]) if inner else 0.0)
            if inner:
                todo += children
            else:
                for k, x in zip(("class_treeids", "class_nodeids", "class_ids"), (tree, node, c), strict=True):
                    n[k].append(x)
                votes.append(float(value[t, c, node]))
    classes = list(range(feature.shape[1]))
    attributes = [_attribute(k, "ints", v) for k, v in n.items()]
    attributes += [_attribute("nodes_values", "floats", values), _attribute("nodes_modes", "strings", modes), _attribute("class_weights", "floats", votes), _attribute("base_values", "floats", a["base"].tolist())]
    attributes += [_attribute("classlabels_int64s", "ints", classes), _attribute("post_transform", "string", "SOFTMAX")]
    return _model([_node("TreeEnsembleClassifier", ["features"], ["class", "probabilities"], "ai.onnx.ml", tuple(attributes))], {}, model.numFeatures, len(classes))


def _net(model) -> bytes:
    """A net's layers one after the other; batch norms by their running figures, dropout left out."""
    from . import networks

    a = model.arrays
    n_features, n_classes = int(a["n_features"]), int(a["classes"])
    nodes, weights, at = [], {}, "features"

    def step(op: str, *more: str, attributes: tuple[bytes, ...] = (), on: str | None = None) -> str:
        nonlocal at
        nodes.append(_node(op, [on or at, *more], [f"x{len(nodes)}"], attributes=attributes))
        at = f"x{len(nodes) - 1}"
        return at

    def constant(name: str, x: np.ndarray) -> str:
        weights[name] = x
        return name

    mean = lambda axis, keep: (_attribute("axes", "ints", [axis]), _attribute("keepdims", "int", keep))
    for k, layer in enumerate(networks.layers(str(a["kind"]), n_features, n_classes, 0.0, 0)):
        match layer:
            case networks.Linear():
                step("MatMul", constant(layer.w, a[layer.w]))
                step("Add", constant(layer.b, a[layer.b]))
            case networks.Norm(batch=True):
                scale = a[layer.g] / np.sqrt(a[layer.var] + networks.EPS)
                step("Mul", constant(layer.g, scale.reshape(layer.shape)))
                step("Add", constant(layer.b, (a[layer.b] - a[layer.mean] * scale).reshape(layer.shape)))
            case networks.Norm():
                x = at
                middle = step("ReduceMean", attributes=mean(1, 1))
                centred = step("Sub", middle, on=x)
                step("Mul", centred)
                step("ReduceMean", attributes=mean(1, 1))
                step("Add", constant(f"eps{k}", np.array([networks.EPS])))
                step("Div", step("Sqrt"), on=centred)
                step("Mul", constant(layer.g, a[layer.g]))
                step("Add", constant(layer.b, a[layer.b]))
            case networks.Relu():
                step("Relu")
            case networks.Channels():
                step("Reshape", constant(f"shape{k}", np.array([0, layer.n, -1])))
            case networks.Conv():
                step("Conv", constant(layer.w, a[layer.w]), constant(layer.b, a[layer.b]), attributes=(_attribute("kernel_shape", "ints", [3]), _attribute("pads", "ints", [1, 1])))
            case networks.MaxPool():
                step("MaxPool", attributes=(_attribute("kernel_shape", "ints", [2]), _attribute("strides", "ints", [2])))
            case networks.Average():
                step("ReduceMean", attributes=mean(2, 0))
            case networks.Dropout():
                pass
            case _:
                raise ValueError(f"{type(layer).__name__} has no portable form")
    nodes.append(_node("Softmax", [at], ["probabilities"], attributes=(_attribute("axis", "int", -1),)))
    return _model(nodes, weights, n_features, n_classes)


def to_onnx(model: Model) -> bytes:
    """A head as an ONNX file: features [n, d] in, probabilities [n, classes] out. Boosted trees, nets, logistic heads, Spark's perceptrons and random forests have one."""
    kind = type(model).__name__
    if kind == "BoostedModel":
        return _boosted(model)
    if kind == "NetModel":
        return _net(model)
    if kind == "LogisticRegressionModel":
        return _dense([(model.coefficientMatrix.toArray().T, model.interceptVector.toArray())])
    if kind == "MultilayerPerceptronClassificationModel":
        sizes, flat, at, layers = model.getLayers(), model.weights.toArray(), 0, []
        for a, b in zip(sizes[:-1], sizes[1:], strict=True):
            layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return _dense(layers)
    if kind in ("RandomForestClassificationModel", "ForestModel"):
        return _forest(model)
    raise ValueError(f"{kind} has no portable form")


def score(df: DataFrame, onnx: bytes, features: str = "features", out: str = "probs", batch: int = 256) -> DataFrame:
    """Adds the class probabilities that an ONNX head gives for vectors; the file goes to every worker."""
    shared = df.sparkSession.sparkContext.broadcast(onnx)

    def make():
        import onnxruntime

        session = onnxruntime.InferenceSession(shared.value, providers=["CPUExecutionProvider"])
        return lambda x: session.run(["probabilities"], {"features": np.asarray(x, np.float32)})[0]

    n = df.select(features).head()
    if n is None:
        return df.withColumn(out, F.lit(None).cast("array<float>"))
    run = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[n[0].size]])
    return df.withColumn(out, run(vector_to_array(features, "float32")))
