"""What a review begins with: parameters, contribution ledgers, merged readings, stored documents, facts of parties, and the record of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.plans import views
from tallyline.plans.schemas import Tables

CENTS = "decimal(18,2)"


def default_parameters(inputs: DataFrame) -> DataFrame:
    """(community_id, key, value_num, version, valid_from): first versions from inputs(community_id, works_spend, ordinary_budget)."""
    works, ordinary = (F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast(CENTS) for c in ("works_spend", "ordinary_budget"))
    share = F.lit("0.01").cast("decimal(3,2)")
    pm = (works * share).cast(CENTS)
    #: Statutory limits and standards, with the day from which each holds.
    made = [
        ("pm_works", pm, "1900-01-01"), ("pm_ordinary", (ordinary * share * 5).cast(CENTS), "1900-01-01"), ("trivial_floor", F.greatest((pm * share * 10).cast(CENTS), F.lit(200).cast(CENTS)), "1900-01-01"),
        ("outflow_min", F.lit(300), "1900-01-01"), ("authority_threshold", F.lit(1000), "1900-01-01"), ("funding_gap_min", F.greatest(F.lit(5000).cast(CENTS), (works * share * 10).cast(CENTS)), "1900-01-01"),
        ("upfront_max_pct_obra", F.lit(40), "1900-01-01"), ("upfront_max_pct_ascensor", F.lit(60), "1900-01-01"), ("cash_limit", F.lit(2500), "1900-01-01"), ("cash_limit", F.lit(1000), "2021-07-11"),
        ("convene_days", F.lit(30), "1900-01-01"), ("ocr_min", F.lit(1000), "1900-01-01"),
    ]
    later = Window.partitionBy("community_id", "key").orderBy("valid_from")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("decimal(38,10)").alias("value_num"), F.lit(day).cast("date").alias("valid_from")) for k, v, day in made))).alias("p")
    rows = inputs.select("community_id", each).select("community_id", "p.key", "p.value_num", "p.valid_from")
    return rows.withColumn("version", F.row_number().over(later))


#: Fixed value: of a community's units, about so many meet its rules at a time.
UNITS = 2048


def contribution_classes(rules: DataFrame, units: DataFrame) -> DataFrame:
    """(derrama_id, period, expected, unit_ids array of struct(unit_id)): what a month of rules(derrama_id, community_id, criterion, total, per_unit, starts_on, months) asks of units(id, community_id, quota).

    criterion is partes_iguales (per_unit a month) or coeficiente (total by the unit's share of all quotas, over the months). A community's units are dealt to blocks, and
    a rule goes to each of them, so a community is many tasks' work. Units of a block with one quota owe the same: the amount is
    computed once for them, and unit_ids names them all.
    """
    sums = units.groupBy("community_id").agg(F.sum(F.coalesce("quota", F.lit(0))).alias("all_quotas"), F.ceil(F.count(F.lit(1)) / UNITS).cast("int").alias("blocks"))
    n = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as the rows that meet say nothing of how many come out
    block = F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block")
    dealt = units.join(sums.select("community_id", "blocks"), "community_id").select("community_id", block, "quota", "id")
    same = dealt.groupBy("community_id", "block", "quota").agg(F.collect_list(F.struct(F.col("id").alias("unit_id"))).alias("unit_ids"))
    blocks = same.groupBy("community_id", "block").agg(F.collect_list(F.struct("quota", "unit_ids")).alias("classes")).repartition(n, "community_id", "block")
    due = rules.where("starts_on IS NOT NULL AND months > 0").select("derrama_id", "community_id", "criterion", "total", "per_unit", "starts_on", "months").join(sums, "community_id")
    due = due.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).repartition(n, "community_id", "block")
    rows = due.join(blocks.hint("merge"), ["community_id", "block"]).withColumn("_c", F.explode("classes"))
    shared = F.when(F.col("all_quotas") > 0, F.col("total").cast("decimal(18,6)") * F.coalesce("_c.quota", F.lit(0)) / F.col("all_quotas") / F.col("months"))
    expected = F.when(F.col("criterion") == "partes_iguales", F.col("per_unit").cast("double")).when(F.col("criterion") == "coeficiente", shared.cast("double"))
    rows = rows.withColumn("expected", F.round(expected.cast("decimal(28,8)"), 2).cast(CENTS)).where("expected IS NOT NULL")
    months = F.explode(F.transform(F.sequence(F.lit(0), F.col("months") - 1), lambda i: F.add_months("starts_on", i))).alias("period")
    return rows.select("derrama_id", months, "expected", F.col("_c.unit_ids").alias("unit_ids"))


def contribution_ledger(rules: DataFrame, units: DataFrame) -> DataFrame:
    """(derrama_id, unit_id, period, expected): one row a unit and month of the rules; see contribution_classes."""
    return contribution_classes(rules, units).select("derrama_id", F.inline("unit_ids"), "period", "expected")


def merge_chunks(chunks: DataFrame, document: str, order: str, arrays: list[str]) -> DataFrame:
    """One row a document of readings of its parts: arrays end to end in order, of other columns the first value that is known."""
    others = [c for c in chunks.columns if c not in (document, order, *arrays)]
    joined = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(a, F.array().cast(chunks.schema[a].dataType)).alias("v")))), lambda s: s["v"])).alias(a) for a in arrays]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others]
    return chunks.groupBy(document).agg(*joined, *first)


def approved_amount(amounts: Column) -> Column:
    """Of an array of amounts that minutes mention, the largest in absolute value, the first of equals; null without any."""
    known = F.transform(F.filter(amounts, lambda v: v.isNotNull()), lambda v, i: F.struct(F.abs(v).alias("size"), (-i).alias("at"), v.alias("v")))
    return F.array_max(known)["v"]


#: Fixed value: percent of the declared price that the tax on works takes, by year.
WORKS_TAX = {2021: 4, 2022: 4, 2023: 4, 2024: 4, 2025: 4, 2026: 4}


def expected_works_tax(price: Column, year: Column) -> Column:
    """The tax that a declared price leads to in a year, in cents; null for a year without a rate on file."""
    rate = F.try_element_at(F.create_map(*(F.lit(x) for p in WORKS_TAX.items() for x in p)), year.cast("int"))
    return (price.cast(CENTS) * rate / 100).cast(CENTS)


def store(docs: DataFrame, kind: str) -> dict[str, DataFrame]:
    """Nested documents of a kind (see validators.DOCUMENTS) as rows of the domain: its own table and one for each of its lists.

    Rows of a list carry the document's id and their place in it, so storing a document again gives the same keys.
    """
    fields = [f for f in docs.schema.fields if f.name != "document_id"]
    plain = [f.name for f in fields if f.dataType.typeName() not in ("array", "struct")]
    structs = [F.col(f.name)[g.name].alias(f"{f.name}_{g.name}") for f in fields if f.dataType.typeName() == "struct" for g in f.dataType.fields]
    out = {kind: docs.select("document_id", *plain, *structs)}

    def lists(rows: DataFrame, keys: list[str], path: str, inner):
        for f in inner:
            if f.dataType.typeName() != "array":
                continue
            name = f"{path}.{f.name}"
            place = f"{f.name}_n"
            each = rows.select(*keys, F.posexplode(f.name).alias(place, "_row"))
            leaves = f.dataType.elementType.fields
            out[name] = each.select(*keys, place, *(F.col("_row")[g.name].alias(g.name) for g in leaves if g.dataType.typeName() != "array"))
            lists(each.select(*keys, place, "_row.*"), [*keys, place], name, leaves)

    lists(docs, ["document_id"], kind, fields)
    return out


def party_facts(t: Tables) -> DataFrame:
    """One row a party with what invoices, accounts and documents say of it: pre-aggregates, joined by id."""
    number = F.regexp_extract("numero", r"(\d+)\s*$", 1).try_cast("bigint")
    works = F.col("works_package_id").isNotNull()
    zero = F.lit(0).cast(views.W)
    inv = t["invoices"].groupBy("community_id", F.col("vendor_party_id").alias("id")).agg(
        F.min("fecha_expedicion").alias("first_invoice"), F.count(F.lit(1)).alias("invoice_count"), F.sum("total").cast(views.W).alias("invoice_total"), F.sum(F.when(works, F.col("total"))).cast(views.W).alias("works_total"),
        F.sum(F.when(~works, F.col("total"))).cast(views.W).alias("ordinary_total"), F.array_sort(F.collect_set("category_code")).alias("categories"), F.array_sort(F.collect_set(number)).alias("numbers"),
    )
    accounts = t["party_ibans"].groupBy(F.col("party_id").alias("id")).agg(F.array_sort(F.collect_set("iban_hmac")).alias("iban_hmacs"))
    out = t["parties"].join(inv, ["community_id", "id"], "left").join(accounts, "id", "left")
    filled = {c: F.coalesce(c, zero) for c in ("invoice_total", "works_total", "ordinary_total")} | {"invoice_count": F.coalesce("invoice_count", F.lit(0))}
    none = {c: F.coalesce(c, F.array().cast(kind)) for c, kind in (("categories", "array<string>"), ("numbers", "array<bigint>"), ("iban_hmacs", "array<string>"))}
    return out.withColumns(filled | none)


def run_metadata(t: Tables, findings: DataFrame, rules: list[tuple[str, str]], today) -> DataFrame:
    """One row a community: the parameters in force, versions of the rules, a hash of the inputs' sizes, and findings by tier."""
    day = F.lit(today)
    in_force = t["parameters"].where(F.col("valid_from") <= day).groupBy("community_id", "key").agg(F.max_by("value_num", F.struct("version", "valid_from")).alias("v"))
    params = in_force.groupBy("community_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("key", F.col("v").cast("decimal(20,4)").alias("value"))))).alias("parameters"))
    sizes = None
    for name in ("bank_transactions", "documents", "invoices", "liquidation_lines", "recon_links"):
        one = t[name].groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).select("community_id", F.lit(name).alias("name"), "n")
        sizes = one if sizes is None else sizes.unionByName(one)
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", F.col("n").cast("string")))), ",")
    inputs = sizes.groupBy("community_id").agg(F.sha2(text, 256).alias("inputs_hash"))
    tiers = findings.groupBy("community_id").agg(F.count(F.lit(1)).alias("findings"), *(F.count_if(F.col("tier") == x).alias(x.lower()) for x in ("T1", "T2", "T3")))
    versions = ",".join(f"{code}:{version}" for code, version in sorted(rules))
    out = t["communities"].select(F.col("id").alias("community_id"), F.lit(versions).alias("rule_versions")).join(params, "community_id", "left").join(inputs, "community_id", "left").join(tiers, "community_id", "left")
    return out.fillna(0, ["findings", "t1", "t2", "t3"])


SEED = {
    "units": "label string, quota_pct double", "meetings": "fecha string, tipo string", "resolutions": "meeting string, punto string, kind string, importe double", "parameters": "key string, value_num double, version int, valid_from string",
    "derramas": "objeto string, criterio string, importe_total double, per_unit_amount double, starts_on string, months int", "accounts": "label string, purpose string", "works_packages": "code string, label string",
    "requests": "class string, fiscal_year int, requested_on string",
}


def read_seed(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Tables of a YAML seed: a mapping of lists of flat mappings. A seed describes one community by hand, so it is small and read on the driver.

    Unknown tables, unknown keys and values that aren't of their column's kind raise ValueError.
    """
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading seeds needs the package yaml") from error
    found = yaml.safe_load(text) or {}
    made = {}
    for name, rows in found.items():
        if name not in SEED:
            raise ValueError(f"unknown table {name}")
        schema = spark.createDataFrame([], SEED[name]).schema
        kinds = {"string": str, "double": (int, float), "integer": int}
        for row in rows or []:
            for key, value in row.items():
                field = next((f for f in schema if f.name == key), None)
                if field is None:
                    raise ValueError(f"{name}: unknown key {key}")
                if value is not None and not isinstance(value if field.dataType.typeName() != "string" else str(value), kinds[field.dataType.typeName()]):
                    raise ValueError(f"{name}.{key}: {value!r}")
        cells = [[None if (v := row.get(f.name)) is None else str(v) if f.dataType.typeName() == "string" else float(v) if f.dataType.typeName() == "double" else v for f in schema] for row in rows or []]
        made[name] = spark.createDataFrame(cells, schema)
    return made
