"""Credential stores (JSON) as edge tables: ingredient traversal and validation dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dims
from .shared import materialize

_STATUS = "struct<success:array<struct<code:string>>,informational:array<struct<code:string>>,failure:array<struct<code:string>>>"
_CHECKED = f"validation_results:struct<activeManifest:{_STATUS}>,validation_status:array<struct<code:string>>,validation_state:string"
_INGREDIENT = f"struct<active_manifest:string,{_CHECKED}>"
STORE_TYPE = f"struct<active_manifest:string,{_CHECKED},manifests:map<string,struct<claim_generator:string,signature_info:struct<issuer:string,time:string>,ingredients:array<{_INGREDIENT}>>>>"


def parse_store(store_json: Column) -> Column:
    return F.from_json(store_json, STORE_TYPE)


def _codes(items: Column) -> Column:
    codes = F.transform(F.coalesce(items, F.array().cast("array<struct<code:string>>")), lambda s: s["code"])
    return F.filter(F.array_compact(codes), lambda c: c != "")


def status_codes(checked: Column) -> tuple[Column, Column, Column]:
    """(successes, informationals, failures); the flat status list counts only when the results name no code."""
    active = checked["validation_results"]["activeManifest"]
    ok, info, bad = (_codes(active[k]) for k in ("success", "informational", "failure"))
    none = F.size(ok) + F.size(info) + F.size(bad) == 0
    return ok, info, F.when(none, _codes(checked["validation_status"])).otherwise(bad)


def _any_part(codes: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(codes, lambda c: F.coalesce(*[F.when(F.contains(c, F.lit(p)), True) for p in parts], F.lit(False)))


def invalid_credential(checked: Column) -> Column:
    bad = status_codes(checked)[2]
    return _any_part(bad, dims.BINDING_FAILURES) | F.exists(bad, lambda c: c.isin(*dims.SIGNATURE_FAILURES))


def validation(checked: Column) -> Column:
    """STRUCT of state, integrity, signature, trust, validity and the distinct codes in their order."""
    ok, info, bad = status_codes(checked)
    has = lambda codes, code: F.array_contains(codes, code)
    integrity = F.when(_any_part(bad, dims.BINDING_FAILURES), "invalid").when(F.exists(ok, lambda c: F.coalesce(*[F.when(F.endswith(c, F.lit(m)), True) for m in dims.BINDING_MATCHES], F.lit(False))), "valid").otherwise("unknown")
    signature = F.when(F.exists(bad, lambda c: c.isin(*dims.SIGNATURE_FAILURES)), "invalid").when(has(ok, "claimSignature.validated"), "valid").otherwise("unknown")
    trust = F.when(has(ok, "signingCredential.trusted"), "trusted").when(has(bad, "signingCredential.untrusted"), "untrusted").otherwise("unknown")
    revoked = has(bad, "signingCredential.invalid") | has(bad, "signingCredential.ocsp.revoked")
    validity = F.when(revoked, "invalid").when(has(bad, "signingCredential.expired"), "expired").when(has(ok, "claimSignature.insideValidity"), "valid").otherwise("unknown")
    state = F.coalesce(F.nullif(checked["validation_state"], F.lit("")), F.lit("unknown"))
    return F.struct(state.alias("state"), integrity.alias("integrity"), signature.alias("signature"), trust.alias("trust"), validity.alias("validity"), F.array_distinct(F.concat(ok, info, bad)).alias("codes"))


def edges(stores: DataFrame, key: str = "path", store: str = "store") -> DataFrame:
    """(key, parent, ordinal, child, bad) of every ingredient link."""
    parents = stores.select(key, F.explode(f"{store}.manifests").alias("parent", "m"))
    links = parents.select(key, "parent", F.posexplode("m.ingredients").alias("ordinal", "i"))
    return links.where("i.active_manifest IS NOT NULL").select(key, "parent", "ordinal", F.col("i.active_manifest").alias("child"), invalid_credential(F.col("i")).alias("bad"))


def reachable(roots: DataFrame, links: DataFrame, key: str = "path", root: str = "root") -> DataFrame:
    """(key, node, depth): breadth-first reach from each root over links that are not bad; cycles end by themselves.

    Links hold for the key that they carry, or for every key if they have none.  A round joins the frontier with the
    links and drops what is known, so work is one pass over new nodes; the rounds are as many as the deepest chain,
    each written to the shared folder.
    """
    own = [key] if key in links.columns else []
    frontier = materialize(roots.select(key, F.col(root).alias("node"), F.lit(0).alias("depth")).where("node IS NOT NULL").distinct(), "reached")
    usable = materialize(links.where("NOT bad").select(*own, F.col("parent").alias("node"), "child").distinct(), "links")
    reached, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        new = frontier.join(usable, [*own, "node"]).select(key, F.col("child").alias("node")).distinct()
        frontier = materialize(new.join(reached, [key, "node"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        reached = reached.union(frontier)
    return reached


def structured_fields(stores: DataFrame, key: str = "path", store: str = "store") -> DataFrame:
    """Per store the issuers and claim generators of the active manifest and its usable ingredients, nearest first."""
    roots = stores.select(key, F.col(f"{store}.active_manifest").alias("root"))
    chain = reachable(roots, edges(stores, key, store), key)
    nodes = stores.select(key, F.explode(f"{store}.manifests").alias("node", "m"))
    found = chain.join(nodes, [key, "node"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("depth", "node", F.col("m.signature_info.issuer").alias("issuer"), F.col("m.claim_generator").alias("generator")))).alias("c"))
    kept = lambda f: F.array_distinct(F.array_compact(F.transform("c", lambda x: x[f])))
    return found.select(key, kept("issuer").alias("issuers"), kept("generator").alias("claim_generators"))
