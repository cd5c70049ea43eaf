"""A landscape: nodes with sequences, undirected edges, and layers, annotations and embeddings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..functions.sequences import symbols
from ..operators import layers as A
from ..operators import shape as S
from ..operators.diffusion import kernel, rbf_edges
from ..operators.edges import hamming_edges, hamming_edges_binary, knn_edges
from ..sources.files import load_bundle, save_bundle


@dataclass
class Landscape:
    """sequences(node, symbols, ...), edges(u, v, weight, ...) and named tables keyed by node."""

    sequences: DataFrame
    edges: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    annotations: dict[str, DataFrame] = field(default_factory=dict)
    embeddings: dict[str, DataFrame] = field(default_factory=dict)
    active: str | None = None
    domain: str | None = None

    @classmethod
    def build(cls, sequences: DataFrame, *, graph: str = "hamming", k: int = 5, t: int | None = 1, vectors: DataFrame | None = None, bits: int | None = None, edges: DataFrame | None = None, **layers: DataFrame) -> Landscape:
        """Build by kind of graph: hamming, binary (codes of ``bits`` bits), knn or diffusion (of
        vectors; ``t`` steps), or given (``edges``)."""
        if graph in ("knn", "diffusion") and vectors is None:
            raise ValueError(f"{graph} asks for vectors")
        if graph == "hamming":
            edges = hamming_edges(sequences.select("node", "symbols"))
        elif graph == "binary":
            edges = hamming_edges_binary(sequences.select("node", "code"), bits)
        elif graph == "knn":
            edges = knn_edges(vectors, k)
        elif graph == "diffusion":
            edges = kernel(vectors.select("node"), rbf_edges(vectors, k), t)
        elif graph != "given" or edges is None:
            raise ValueError("graph: hamming, binary, knn, diffusion or given (with edges)")
        found = cls(sequences, edges, dict(layers), embeddings={"vectors": vectors} if vectors is not None else {})
        found.active = next(iter(layers), None)
        return found

    @classmethod
    def from_graph(cls, pairs: DataFrame, sequences: DataFrame | None = None, *, weight: str | None = None, **layers: DataFrame) -> Landscape:
        """From any table of pairs (u, v, ...); without ``sequences`` the nodes are the ends of edges.
        A pair with an end that ``sequences`` lacks raises."""
        edges = S.edges_of(pairs, weight)
        ends = G.both_ways(edges.select("u", "v")).select(F.col("u").alias("node")).distinct()
        if sequences is None:
            sequences = ends.withColumn("symbols", F.lit(None).cast("array<string>"))
        elif ends.join(sequences.select("node"), "node", "left_anti").head(1):
            raise ValueError("edges between nodes that there are not")
        return cls.build(sequences, graph="given", edges=edges, **layers)

    @classmethod
    def from_graph_annotated(cls, pairs: DataFrame, annotations: DataFrame, *, weight: str | None = None, **layers: DataFrame) -> Landscape:
        """From pairs and annotations(node, ...); the columns ``symbols`` or ``sequence`` become
        sequences, all others the annotation table "nodes"."""
        columns = annotations.columns
        seq = F.col("symbols") if "symbols" in columns else symbols(F.col("sequence")) if "sequence" in columns else F.lit(None).cast("array<string>")
        found = cls.from_graph(pairs, annotations.select("node", seq.alias("symbols")), weight=weight, **layers)
        return found.attach_annotation("nodes", annotations.select("node", *(c for c in columns if c not in ("node", "symbols", "sequence"))))

    @classmethod
    def from_alignment(cls, alignment: DataFrame, **options) -> Landscape:
        """From an alignment (name, symbols): rows of one length; equal rows stay nodes of their own."""
        sizes = alignment.agg(F.min(F.size("symbols")), F.max(F.size("symbols"))).first()
        if sizes[0] != sizes[1]:
            raise ValueError("rows of unequal length")
        return cls.build(alignment.withColumnRenamed("name", "node"), **options)

    def layer(self, name: str) -> DataFrame:
        if name not in self.layers:
            raise KeyError(name)
        return self.layers[name]

    def add(self, name: str, layer: DataFrame) -> Landscape:
        """A layer (node, value) as it is; one that names nodes outside raises."""
        if name in self.layers:
            raise ValueError(f"layer {name} is there already")
        if layer.join(self.sequences.select("node"), "node", "left_anti").head(1):
            raise ValueError("values of nodes that there are not")
        self.layers[name] = layer.select("node", "value")
        self.active = self.active or name
        return self

    def modify(self, modifier: A.Modifier, layer: str | None = None, name: str = "modified") -> Landscape:
        """A new layer, of which the modifier makes the values out of another's."""
        source = self.layer(layer or self.active)
        new, made = A.apply_modifier(source.withColumnRenamed("node", "row_id"), modifier, set(self.layers), name)
        self.layers[new] = made.select(F.col("row_id").alias("node"), "value")
        return self

    def table(self) -> DataFrame:
        """(node, a column for each layer)."""
        return S.wide(self.layers)

    def attach_annotation(self, name: str, annotation: DataFrame) -> Landscape:
        """Annotations (node, ...), one row a node at most."""
        if name in self.annotations:
            raise ValueError(f"annotation {name} is there already")
        if annotation.groupBy("node").count().where("count > 1").head(1):
            raise ValueError("several rows for one node")
        self.annotations[name] = annotation
        return self

    def annotation(self, name: str) -> DataFrame:
        if name not in self.annotations:
            raise KeyError(name)
        return self.annotations[name]

    def detach_annotation(self, name: str) -> Landscape:
        self.annotation(name)
        del self.annotations[name]
        return self

    def annotation_to_layer(self, name: str, column: str, layer: str, *, numeric: bool = False) -> Landscape:
        rows = self.annotation(name).withColumnRenamed("node", "row_id")
        made = A.to_numeric(rows, column) if numeric else A.to_category(rows, column)
        return self.add(layer, made.withColumnRenamed("row_id", "node"))

    def communities(self, name: str = "communities", resolution: float = 1.0) -> Landscape:
        return self.attach_annotation(name, S.louvain(self.sequences.select("node"), self.edges, resolution))

    def embedding(self, name: str | None = None) -> DataFrame:
        """(node, vector) of a domain, or of the one set active; without either, of the only one."""
        name = name or self.domain or (next(iter(self.embeddings)) if len(self.embeddings) == 1 else None)
        if name not in self.embeddings:
            raise KeyError(name)
        return self.embeddings[name]

    def set_domain(self, name: str) -> Landscape:
        if name not in self.embeddings:
            raise KeyError(name)
        self.domain = name
        return self

    def embedding_facts(self, name: str | None = None) -> DataFrame:
        """One row: how many vectors there are and how wide they are."""
        return self.embedding(name).agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least_width"), F.max(F.size("vector")).alias("width"))

    def sequence_of(self, node: object) -> list | None:
        found = self.sequences.where(F.col("node") == F.lit(node)).select("symbols").head(1)
        if not found:
            raise KeyError(node)
        return found[0]["symbols"]

    def mutations(self) -> DataFrame:
        return S.edge_mutations(self.edges, self.sequences)

    def view(self, name: str) -> Landscape:
        if name not in self.layers:
            raise KeyError(name)
        self.active = name
        return self

    def signal(self) -> DataFrame:
        """nodes(node, value) of the active layer."""
        if self.active is None:
            raise ValueError("no layer")
        return self.layers[self.active].select("node", "value")

    def attach(self, name: str, values: DataFrame, key: str = "node", **policy) -> Landscape:
        if name in self.layers:
            raise ValueError(f"layer {name} is there already")
        self.layers[name] = A.attach(self.sequences.select("node", *({key} - {"node"})), values, key, **policy).select("node", "value")
        self.active = self.active or name
        return self

    def detach(self, name: str) -> Landscape:
        del self.layers[name]
        if self.active == name:
            self.active = next(iter(self.layers), None)
        return self

    def query(self, annotation: str, criteria: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """The annotated nodes that meet the criteria, and the edges among them."""
        rows = A.query(self.annotations[annotation], criteria)
        return rows, G.induced(self.edges, rows.select("node"))

    def quotient(self, blocks: DataFrame, how: str = "mean") -> tuple[DataFrame, DataFrame]:
        nodes = self.signal().join(blocks, "node", "left")
        return G.quotient_nodes(nodes, how), G.quotient_edges(nodes, self.edges)

    def parts(self) -> DataFrame:
        """(node, component, size) by falling size."""
        label = G.components(self.sequences.select("node"), self.edges)
        return label.join(label.groupBy("component").agg(F.count("*").alias("size")), "component").orderBy(F.desc("size"), "component", "node")

    def save(self, path: str, **options) -> None:
        tables = {"sequences": self.sequences, "edges": self.edges}
        for kind in ("layers", "annotations", "embeddings"):
            tables |= {f"{kind}.{n}": df for n, df in getattr(self, kind).items()}
        save_bundle(tables, path, metadata={"active": self.active}, **options)

    @classmethod
    def load(cls, spark, path: str) -> Landscape:
        tables, meta = load_bundle(spark, path)
        out = cls(tables.pop("sequences"), tables.pop("edges"), active=meta["active"])
        for name, df in tables.items():
            kind, _, n = name.partition(".")
            getattr(out, kind)[n] = df
        return out
