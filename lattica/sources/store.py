"""A versioned store of datasets: Parquet members and a chain of manifests; the newest manifest is the dataset."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.dataset import Dataset

#: Cells of one directory of X: an obs filter that keeps few shards reads few directories (dynamic partition pruning).
SHARD_CELLS = 1 << 20
#: Columns of up to so many distinct values get an index of each shard's values by themselves; asked for, up to MOST_VALUES.
AUTO_VALUES, MOST_VALUES = 1000, 100_000
#: Preset columns that are indexed where they are there, however many values they have up to MOST_VALUES.
PRESET = ("cell_type", "tissue", "disease", "donor_id", "assay", "perturbation")


def shard_statistics(obs: DataFrame, shard_cells: int = SHARD_CELLS, index: list[str] | None = None) -> DataFrame:
    """One row a shard (cell_ix divided by shard_cells): its cells, and of every numeric, string, date and boolean column
    the least and largest value, the nulls, and, for columns with an index, the values it holds."""
    index = index or []
    kinds = {f.name: f.dataType.simpleString() for f in obs.schema.fields if f.name != "cell_ix"}
    plain = [c for c, t in kinds.items() if t in ("string", "date", "timestamp", "timestamp_ntz", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    if unknown := [c for c in index if c not in plain]:
        raise StoreError(f"no column that can be indexed: {unknown}")
    distinct = obs.agg(F.lit(0).alias("_"), *[F.approx_count_distinct(c).alias(c) for c in plain]).first().asDict()
    exact = obs.agg(F.lit(0).alias("_"), *[F.count_distinct(c).alias(c) for c in plain if distinct[c] <= 1.2 * MOST_VALUES and (c in index or c in PRESET or kinds[c] == "string")]).first().asDict()
    if too := [c for c in index if exact.get(c, MOST_VALUES + 1) > MOST_VALUES]:
        raise StoreError(f"more than {MOST_VALUES} distinct values in {too}")
    held = {c for c in plain if c in index or exact.get(c, MOST_VALUES + 1) <= (MOST_VALUES if c in PRESET else AUTO_VALUES)}
    out = [F.count("*").alias("n_cells")]
    for c in plain:
        values = F.array_sort(F.collect_set(c)) if c in held else F.lit(None).cast(f"array<{kinds[c]}>")
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls"), values.alias(f"{c}_values")]
    return obs.groupBy(F.floor(F.col("cell_ix") / shard_cells).cast("long").alias("shard_id")).agg(*out)


def shards_to_read(statistics: DataFrame, schema, text: str, null_mode: str = "sql") -> DataFrame:
    """shard_id, n_cells, may_match of every shard for a predicate; a shard that may not match holds no matching cell."""
    from lattica.plans.predicate import compile_reach

    return statistics.select("shard_id", "n_cells", compile_reach(text, schema, null_mode).alias("may_match"))


def content_checksum(frame: DataFrame) -> DataFrame:
    """One row: rows and an order-free checksum over all columns."""
    h = F.xxhash64(*sorted(frame.columns)).cast("decimal(38,0)")
    return frame.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


class StoreError(RuntimeError):
    """The store changed meanwhile, or a version or member is missing or wrong."""


class Store:
    """Reads and writes through Hadoop's file systems, so any URI that Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str, shard_cells: int = SHARD_CELLS, index: list[str] | None = None):
        self.spark, self.path, self.shard_cells, self.index = spark, path.rstrip("/"), shard_cells, index
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifest")
        if not self.fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        version = have[-1] if version is None and have else version
        if version not in have:
            raise StoreError(f"no version {version}; there are {have}")
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/_manifest/{version:08d}.json").collect()))

    def _commit(self, members: dict, action: str, base: int | None, uns: dict) -> int:
        version = (base if base is not None else -1) + 1
        body = {"version": version, "members": members, "uns": uns, "shard_cells": self.shard_cells, "history": (self.manifest(base)["history"] if base is not None else []) + [action]}
        temp, final = self._path(f"{self.path}/_manifest/.{uuid.uuid4().hex}"), self._path(f"{self.path}/_manifest/{version:08d}.json")
        out = self.fs.create(temp, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        # renaming onto an existing name fails: of two writers from one base, the last loses
        if self.fs.exists(final) or not self.fs.rename(temp, final):
            self.fs.delete(temp, False)
            raise StoreError(f"version {version} is there already: the store changed meanwhile")
        return version

    # ---- members

    def _write(self, frame: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        if name.startswith(("x", "layer")):
            frame = frame.withColumn("shard_id", F.floor(F.col("cell_ix") / self.shard_cells).cast("long"))
            frame.repartitionByRange("cell_ix").sortWithinPartitions("cell_ix", "gene_ix").write.partitionBy("shard_id").parquet(path)
        else:
            frame.write.parquet(path)
        return path

    def save(self, d: Dataset, action: str = "save", base: int | None = None) -> int:
        """Writes all members as a new version (of the head unless base is given)."""
        have = self.versions()
        base = have[-1] if base is None and have else base
        members = {"obs": self._write(d.obs, "obs"), "var": self._write(d.var, "var"), "x": self._write(d.x, "x")}
        members |= {f"layer:{k}": self._write(v, f"layer_{k}") for k, v in d.layers.items()}
        members |= {f"obsm:{k}": self._write(v, f"obsm_{k}") for k, v in d.obsm.items()}
        members |= {f"obsp:{k}": self._write(v, f"obsp_{k}") for k, v in d.obsp.items()}
        members |= {f"varm:{k}": self._write(v, f"varm_{k}") for k, v in d.varm.items()}
        members["statistics"] = self._write(shard_statistics(self.spark.read.parquet(members["obs"]), self.shard_cells, self.index), "statistics")
        if d.tombstones is not None:
            members["tombstones"] = self._write(d.tombstones, "tombstones")
        return self._commit(members, action, base, d.uns)

    def open(self, version: int | None = None) -> Dataset:
        m = self.manifest(version)
        read = lambda p: self.spark.read.parquet(p)
        members = m["members"]
        pick = lambda kind: {k.split(":", 1)[1]: read(p) for k, p in members.items() if k.startswith(kind + ":")}
        x = lambda f: f.select("cell_ix", "gene_ix", "value", *(["shard_id"] if "shard_id" in f.columns else []))
        return Dataset(
            read(members["obs"]), read(members["var"]), x(read(members["x"])).drop("shard_id"), {k: v.drop("shard_id") for k, v in pick("layer").items()}, pick("obsm"), pick("obsp"), pick("varm"),
            uns=m["uns"], tombstones=read(members["tombstones"]) if "tombstones" in members else None,
        )

    def rollback(self, version: int | None = None) -> int:
        """A new version with the members of an earlier one (the one before the head by default)."""
        have = self.versions()
        target = have[-2] if version is None else version
        m = self.manifest(target)
        return self._commit(m["members"], f"rollback to {target}", have[-1], m["uns"])

    def _with(self, changes: dict, action: str, uns: dict | None = None) -> int:
        head = self.versions()[-1]
        m = self.manifest(head)
        return self._commit(m["members"] | changes, action, head, m["uns"] if uns is None else uns)

    def save_layer(self, name: str, layer: DataFrame) -> int:
        return self._with({f"layer:{name}": self._write(layer, f"layer_{name}")}, f"layer {name}")

    def modify_obs(self, obs: DataFrame) -> int:
        """New annotations of the same cells; values aren't rewritten."""
        return self.modify(obs=obs)

    def modify(self, obs: DataFrame | None = None, var: DataFrame | None = None, obsm: dict | None = None, varm: dict | None = None, uns: dict | None = None) -> int:
        """New annotations, embeddings (None removes one), loadings and uns; values aren't rewritten. The keys must be the
        same as before."""
        d, head = self.open(), self.manifest()
        changes: dict[str, str | None] = {}
        for name, new, old, key in (("obs", obs, d.obs, "cell_ix"), ("var", var, d.var, "gene_ix")):
            if new is not None:
                if not new.select(key).exceptAll(old.select(key)).unionAll(old.select(key).exceptAll(new.select(key))).isEmpty():
                    raise StoreError(f"{name} has other keys than before")
                changes[name] = self._write(new, name)
        if obs is not None:
            changes["statistics"] = self._write(shard_statistics(self.spark.read.parquet(changes["obs"]), self.shard_cells, self.index), "statistics")
        for kind, new in (("obsm", obsm or {}), ("varm", varm or {})):
            for k, f in new.items():
                changes[f"{kind}:{k}"] = None if f is None else self._write(f, f"{kind}_{k}")
        members = {k: v for k, v in (head["members"] | changes).items() if v is not None}
        return self._commit(members, "modify", head["version"], head["uns"] | (uns or {}))

    def mark_deleted(self, cells: DataFrame) -> int:
        d = self.open()
        every = cells.select("cell_ix") if d.tombstones is None else d.tombstones.union(cells.select("cell_ix")).distinct()
        return self._with({"tombstones": self._write(every, "tombstones")}, "delete")

    def set_uns(self, uns: dict) -> int:
        return self._with({}, "uns", uns)

    def update_uns(self, uns: dict) -> int:
        """Top-level keys are replaced, others stay."""
        return self._with({}, "uns", self.manifest()["uns"] | uns)

    def append(self, source: Dataset) -> int:
        from lattica.operators.order import append

        return self.save(append(self.open(), source), "append")

    def compact(self) -> int:
        from lattica.operators.order import compact

        return self.save(replace(compact(self.open())), "compact")

    def build_gene_major(self) -> int:
        """A second copy of X in gene order, for reads along genes: read_genes uses it."""
        frame = self.open().x.repartitionByRange("gene_ix").sortWithinPartitions("gene_ix", "cell_ix")
        path = f"{self.path}/gene_major/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self._with({"gene_major": path}, "gene-major copy")

    def read_genes(self, genes: list[int]) -> DataFrame:
        """Live values of some genes: from the gene-major copy where there is one, whose row groups of other genes are
        skipped by their statistics, else from X."""
        m = self.manifest()["members"]
        d = self.open()
        source = self.spark.read.parquet(m["gene_major"]) if "gene_major" in m else d.x
        return d.live(source.filter(F.col("gene_ix").isin([int(g) for g in genes])))

    def read_obsm(self, name: str, start: int | None = None, stop: int | None = None, cells: list[int] | None = None) -> DataFrame:
        """An embedding: all live rows, those of [start, stop), or those of given cells."""
        d = self.open()
        if name not in d.obsm:
            raise StoreError(f"no embedding {name!r}; there are {sorted(d.obsm)}")
        f = d.live(d.obsm[name])
        if cells is not None:
            return f.filter(F.col("cell_ix").isin([int(c) for c in cells]))
        return f if start is None else f.filter((F.col("cell_ix") >= start) & (F.col("cell_ix") < stop))

    def shards(self, text: str, null_mode: str = "sql") -> DataFrame:
        """Which shards a predicate on cells must read, by their statistics."""
        m = self.manifest()["members"]
        return shards_to_read(self.spark.read.parquet(m["statistics"]), self.spark.read.parquet(m["obs"]).schema, text, null_mode)

    def skip_statistics(self, text: str) -> dict:
        """How many shards a predicate reads and skips, and the cells in them."""
        got = self.shards(text).groupBy("may_match").agg(F.count("*").alias("n"), F.sum("n_cells").alias("cells")).collect()
        n = {r["may_match"]: (r["n"], r["cells"]) for r in got}
        (read, cells), (skipped, left) = n.get(True, (0, 0)), n.get(False, (0, 0))
        return {"shards": read + skipped, "skipped": skipped, "cells": cells, "cells_skipped": left, "skip_rate": skipped / max(1, read + skipped)}

    def read_matching(self, text: str, null_mode: str = "sql") -> DataFrame:
        """Values of the live cells that match a predicate; only the directories of shards that may match are listed."""
        from lattica.plans.predicate import compile_predicate

        d, m = self.open(), self.manifest()["members"]
        keep = [r[0] for r in self.shards(text, null_mode).filter("may_match").select("shard_id").collect()]  # one number a shard
        x = self.spark.read.parquet(m["x"]).filter(F.col("shard_id").isin(keep)).drop("shard_id")
        cells = d.read_obs().filter(compile_predicate(text, d.obs.schema, null_mode)).select("cell_ix")
        return x.join(cells, "cell_ix", "left_semi")

    def optimize(self, sort_by: list[str] | None = None) -> int:
        """Rewrites all members: deletions are applied, small files become few, and cells come in the order of sort_by, which
        keeps like cells in few shards."""
        from lattica.operators.order import apply_order, compact, sort_cells

        d = self.open()
        return self.save(compact(d) if sort_by is None else apply_order(d, sort_cells(d, sort_by)), "optimize")

    upgrade = optimize

    def preprocess(self, target: Store, steps: list[tuple[str, dict]]) -> int:
        """A new store with steps applied in order: filter_cells, filter_genes (bounds as filter_axis has them), subset
        (obs, var predicates), normalize_total (target), log1p, scale (by), save_layer (name)."""
        from lattica.operators.features import filter_axis
        from lattica.operators.order import subset
        from lattica.operators.transform import elementwise, normalize_total
        from lattica.plans.predicate import compile_predicate
        from lattica.sources.shared import materialize

        d = self.open()
        for name, options in steps:
            if name in ("filter_cells", "filter_genes"):
                axis, key = ("cell", "cell_ix") if name == "filter_cells" else ("gene", "gene_ix")
                keep = materialize(filter_axis(d, axis, **options).select(key), "preprocess")
                frame = (d.read_obs() if axis == "cell" else d.var).join(keep, key, "left_semi")
                kept = replace(d, obs=frame) if axis == "cell" else replace(d, var=frame)
                d = subset(kept, F.lit(True) if axis == "cell" else None, F.lit(True) if axis == "gene" else None)
            elif name == "subset":
                where = lambda key, frame: compile_predicate(options[key], frame.schema) if options.get(key) else None
                d = subset(d, where("obs", d.obs), where("var", d.var))
            elif name == "normalize_total":
                d = d.with_x(normalize_total(d, options.get("target")))
            elif name == "log1p":
                d = d.with_x(elementwise(d.matrix(), "log1p"))
            elif name == "scale":
                d = d.with_x(elementwise(d.matrix(), "multiply", float(options["by"])))
            elif name == "save_layer":
                d = replace(d, layers=d.layers | {options["name"]: d.x})
            else:
                raise StoreError(f"no step {name!r}")
        return target.save(d, "preprocess " + ",".join(n for n, _ in steps))

    def info(self) -> dict:
        """Version, sizes and names of members."""
        m, d = self.manifest(), self.open()
        names = lambda kind: sorted(k.split(":", 1)[1] for k in m["members"] if k.startswith(kind + ":"))
        return {
            "version": m["version"], "n_cells": d.read_obs().count(), "n_genes": d.var.count(), "n_values": d.matrix().count(),
            "layers": names("layer"), "obsm": names("obsm"), "obsp": names("obsp"), "varm": names("varm"), "uns_keys": sorted(m["uns"]),
        }

    def provenance(self) -> list[str]:
        """The actions that led to the head, oldest first."""
        return list(self.manifest()["history"])

    def checksums(self) -> dict[str, tuple[int, str]]:
        """Rows and checksum of every member of the head; equal contents give equal ones, whatever files hold them."""
        out = {}
        for name, path in sorted(self.manifest()["members"].items()):
            r = content_checksum(self.spark.read.parquet(path)).first()
            out[name] = (r["n_rows"], r["checksum"])
        return out

    def watch(self, since: int) -> int | None:
        """The newest version if it is later than `since`."""
        have = self.versions()
        return have[-1] if have and have[-1] > since else None


def validate(d: Dataset) -> DataFrame:
    """One row of counts of what is wrong: repeated coordinates, stored zeros, unknown cells and genes, repeated keys."""
    x = d.x
    one = x.agg(F.coalesce(F.sum((F.col("value") == 0).cast("long")), F.lit(0)).alias("stored_zeros"))
    n = lambda f, name: f.agg(F.count("*").alias(name))
    parts = [
        n(x.groupBy("cell_ix", "gene_ix").count().filter("count > 1"), "repeated_coordinates"),
        n(x.join(d.obs, "cell_ix", "left_anti"), "unknown_cells"), n(x.join(d.var, "gene_ix", "left_anti"), "unknown_genes"),
        n(d.obs.groupBy("cell_ix").count().filter("count > 1"), "repeated_cells"), n(d.var.groupBy("gene_ix").count().filter("count > 1"), "repeated_genes"),
    ]
    for p in parts:
        one = one.crossJoin(p)  # single rows
    return one
