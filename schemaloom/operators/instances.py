"""Instance tables with consistent keys, the documents made from them, and the checks of both."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from schemaloom.functions.text import add_months_clamped, email, padded_id, random_date
from schemaloom.operators.integrity import missing_keys
from schemaloom.sources.tables import append_new, exists, written

# The value sets of the instance tables.
OWNER_TYPES = ("individual", "LLC", "trust", "corporation")
INDUSTRY_TYPES = ("retail", "office-professional", "restaurant-food service", "medical", "warehouse-logistics", "other")
SERVICE_TYPES = ("HVAC", "plumbing", "electrical", "landscaping", "general contractor", "cleaning", "pest control")
STOREFRONT_TYPES = ("strip mall", "standalone", "mall inline", "street-front")
FOOT_TRAFFIC = ("low", "medium", "high")
ESCALATION_TYPES = ("fixed percentage", "CPI-indexed", "none")
STATUS = (("open", 15), ("assigned", 15), ("in-progress", 20), ("resolved", 50))
PRIORITY = (("low", 30), ("medium", 35), ("high", 25), ("emergency", 10))
PROPERTY_TYPES = ("office", "retail", "industrial")
APPROVAL_THRESHOLD = 1000.0
FIRST = ("Ada", "Ben", "Cleo", "Dan", "Eve", "Finn", "Gia", "Hal", "Ina", "Jon", "Kim", "Leo", "Mia", "Ned", "Oda", "Pam")
LAST = ("Abel", "Boyd", "Cole", "Dunn", "Ellis", "Frost", "Grant", "Hale", "Irwin", "Jones", "Kerr", "Lowe", "Marsh", "Nash", "Owens", "Price")
STREETS = ("Main St", "Oak Ave", "Mill Rd", "Lake Dr", "Hill Blvd", "Park Ln")
FIRMS = ("LLC", "Group", "Partners", "Holdings")


def _chance(salt: str, seed: int) -> Column:
    """A number in [0, 1) from the row's id: the same on any cluster and in any retry."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _number(salt: str, seed: int, low: int, high: int) -> Column:
    return F.floor(_chance(salt, seed) * (high - low + 1)).cast("long") + low


def _one_of(values: tuple, salt: str, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _number(salt, seed, 1, len(values)).cast("int"))


def _weighted(values: tuple, salt: str, seed: int) -> Column:
    out, left = None, 0
    for value, share in values[:-1]:
        left += share
        test = _chance(salt, seed) * 100 < left
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(values[-1][0])


def generate(spark: SparkSession, seed: int = 42, owners: int = 18, agents: int = 14, vendors: int = 12, tenants: int = 35, properties: int = 45, requests: int = 65) -> dict[str, DataFrame]:
    """owners, agents, vendors, properties, tenants, leases, maintenance_requests, each in the order of its keys.

    About 85 % of the properties are leased, about 30 % of those leases are renewed by a second one that begins where the
    first ends. A request belongs to a lease, whose tenant and property it has; its vendor, if it is past open, offers the
    service asked for; costs over ``APPROVAL_THRESHOLD`` need the owner. Keys are picked by number, so nothing is joined
    that grows with the tables but leases to requests."""
    one = lambda *a: _one_of(*a, seed)
    number = lambda *a: _number(a[0], seed, *a[1:])
    key = lambda prefix, n: padded_id(prefix, n)
    person = lambda salt: F.concat(one(FIRST, salt + "f"), F.lit(" "), one(LAST, salt + "l"))
    firm = lambda salt, kinds: F.concat(one(LAST, salt + "l"), F.lit(" "), one(kinds, salt + "k"))
    rows = lambda n, prefix: spark.range(1, n + 1).select(F.col("id").alias("n"), key(prefix, F.col("id")).alias("id"))

    own = rows(owners, "own-").withColumn("ownerType", one(OWNER_TYPES, "type"))
    own = own.withColumn("name", F.when(F.col("ownerType") == "individual", person("own")).otherwise(firm("own", FIRMS)))
    own = own.select("id", "name", email(F.split("name", " ")[0], F.concat(F.lit("owner"), "n", F.lit("mail"))).alias("contactInfo"), "ownerType", F.concat(number("t1", 10, 99), F.lit("-"), number("t2", 1_000_000, 9_999_999)).alias("taxId"))
    agt = rows(agents, "agt-").withColumn("name", person("agt"))
    agt = agt.select("id", "name", email(F.col("name"), F.lit("brokerage")).alias("contactInfo"), F.concat(F.lit("LIC-"), number("lic", 100_000, 999_999)).alias("licenseNumber"), firm("bro", ("Realty", "Brokers")).alias("brokerage"))
    ven = rows(vendors, "ven-").withColumn("name", firm("ven", ("Services", "Solutions", "Maintenance"))).withColumn("insured", _chance("ins", seed) > 0.1)
    service = F.element_at(F.array(*map(F.lit, SERVICE_TYPES)), ((F.col("n") - 1) % len(SERVICE_TYPES) + 1).cast("int"))
    ven = ven.select("id", "name", email(F.concat(F.lit("dispatch"), "n"), F.split("name", " ")[0]).alias("contactInfo"), service.alias("serviceType"), "insured", F.when(F.col("insured"), random_date(2026, 2028, _chance("exp", seed)).cast("string")).alias("insuranceExpiryDate"))
    third = properties // 3
    kind = F.when(F.col("n") <= third, "office").when(F.col("n") <= 2 * third, "retail").otherwise("industrial")
    only = lambda t, c: F.when(F.col("propertyType") == t, c)
    prop = rows(properties, "prop-").withColumn("propertyType", kind)
    prop = prop.select(
        "id", "propertyType", F.concat(number("no", 100, 9999), F.lit(" "), one(STREETS, "street")).alias("address"), number("sqft", 1500, 60000).alias("squareFootage"), key("own-", number("owner", 1, owners)).alias("ownerId"),
        only("office", number("floors", 1, 12)).alias("numberOfFloors"), only("office", number("parking", 10, 300)).alias("parkingSpaces"), only("retail", one(STOREFRONT_TYPES, "front")).alias("storefrontType"),
        only("retail", one(FOOT_TRAFFIC, "traffic")).alias("footTraffic"), only("industrial", F.round(14 + 26 * _chance("ceiling", seed), 1)).alias("ceilingHeight"), only("industrial", number("docks", 1, 20)).alias("loadingDocks"),
    )
    ten = rows(tenants, "ten-").withColumn("businessName", firm("biz", FIRMS))
    ten = ten.select("id", person("ten").alias("name"), email(F.concat(F.lit("contact"), "n"), F.split("businessName", " ")[0]).alias("contactInfo"), "businessName", one(INDUSTRY_TYPES, "ind").alias("industryType"))

    # The lease of a property and its renewal have the numbers 2n - 1 and 2n of the property's.
    start = random_date(2022, 2024, _chance("start", seed))
    end = add_months_clamped(F.col("start"), _one_of((12, 24, 36, 60), "term", seed))
    base = prop.where(_chance("leased", seed) > 0.15).withColumn("start", start).withColumn("end", end).withColumn("rent", F.round(2000 + 43000 * _chance("rent", seed), 2)).withColumn("renewed", _chance("renewed", seed) < 0.3)
    place = F.regexp_extract("id", r"\d+$", 0).cast("long") * 2
    base = base.withColumn("place", place).withColumn("later", F.explode(F.when(F.col("renewed"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    renewal = F.col("later") == 1
    lease = base.select(
        key("lease-", F.col("place") - 1 + F.col("later")).alias("id"), "ownerId", key("ten-", number("tenant", 1, tenants)).alias("tenantId"), F.col("id").alias("propertyId"), key("agt-", number("agent", 1, agents)).alias("negotiatingAgentId"),
        F.when(renewal, F.col("end")).otherwise(F.col("start")).cast("string").alias("startDate"), F.when(renewal, add_months_clamped(F.col("end"), _one_of((12, 24, 36), "more", seed))).otherwise(F.col("end")).cast("string").alias("endDate"),
        F.when(renewal, F.round(F.col("rent") * (1.03 + 0.07 * _chance("rise", seed)), 2)).otherwise(F.col("rent")).alias("rentAmount"), one(ESCALATION_TYPES, "esc").alias("escalationType"), F.round(2000 + 43000 * _chance("deposit", seed), 2).alias("securityDeposit"),
        F.when(F.col("renewed") & ~renewal, key("lease-", F.col("place"))).alias("amendmentLeaseId"),
    )

    # A request names the place of a first lease; it goes to the first one from there on that exists.
    asked = rows(requests, "mr-").withColumn("place", 2 * number("prop", 1, properties) - 1).withColumn("service", one(SERVICE_TYPES, "service")).withColumn("status", _weighted(STATUS, "status", seed)).withColumn("cost", F.round(50 + 5950 * _chance("cost", seed), 2)).withColumn("reported", random_date(2025, 2026, _chance("reported", seed)))
    first = lease.select(F.regexp_extract("id", r"\d+$", 0).cast("long").alias("place"), F.col("id").alias("leaseId"), "tenantId", "propertyId", "ownerId").where("place % 2 = 1")
    gaps = first.withColumn("after", F.coalesce(F.lag("place").over(Window.orderBy("place")), F.max("place").over(Window.partitionBy()) - 2 * properties))  # of the leases' numbers
    span = gaps.select("leaseId", "tenantId", "propertyId", "ownerId", F.explode(F.expr("transform(filter(sequence(after + 2, place), x -> x > after and x % 2 <> 0), x -> x)")).alias("at"))
    span = span.withColumn("place", F.when(F.col("at") < 1, F.col("at") + 2 * properties).otherwise(F.col("at")))
    per = vendors // len(SERVICE_TYPES)
    spare = vendors - per * len(SERVICE_TYPES)
    at = F.array_position(F.array(*map(F.lit, SERVICE_TYPES)), F.col("service"))
    able = F.lit(per) + F.when(at <= spare, 1).otherwise(0)
    chosen = at + F.floor(_chance("vendor", seed) * able).cast("long") * len(SERVICE_TYPES)
    given = F.when((F.col("status") != "open") & (able > 0), key("ven-", chosen))
    req = asked.join(span, "place")
    req = req.select(
        "id", "tenantId", "propertyId", "leaseId", key("agt-", number("agent", 1, agents)).alias("assigningAgentId"), given.alias("resolvingVendorId"), F.when(F.col("cost") > APPROVAL_THRESHOLD, F.col("ownerId")).alias("requiresApprovalOwnerId"),
        "status", _weighted(PRIORITY, "priority", seed).alias("priority"), F.col("reported").cast("string").alias("dateReported"), F.when(F.col("status") == "resolved", F.date_add("reported", number("lag", 1, 21).cast("int")).cast("string")).alias("dateResolved"),
        F.concat(F.col("service"), F.lit(" problem")).alias("description"), F.col("cost").alias("estimatedCost"),
    )
    return {"owners": own, "agents": agt, "vendors": ven, "properties": prop, "tenants": ten, "leases": lease, "maintenance_requests": req}


#: Table, key column, table it points to; keys that may be null are left out where they are.
FOREIGN_KEYS = (
    ("properties", "ownerId", "owners"), ("leases", "ownerId", "owners"), ("leases", "tenantId", "tenants"), ("leases", "propertyId", "properties"), ("leases", "negotiatingAgentId", "agents"),
    ("leases", "amendmentLeaseId", "leases"), ("maintenance_requests", "tenantId", "tenants"), ("maintenance_requests", "propertyId", "properties"), ("maintenance_requests", "leaseId", "leases"),
    ("maintenance_requests", "assigningAgentId", "agents"), ("maintenance_requests", "resolvingVendorId", "vendors"), ("maintenance_requests", "requiresApprovalOwnerId", "owners"),
)
OPTIONAL = ("amendmentLeaseId", "resolvingVendorId", "requiresApprovalOwnerId")


def verify(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, key) of what is wrong: keys without a row, null keys that must not be, ids that two rows of any tables share,
    requests that contradict their lease, an approval that all or no requests need."""
    row = lambda df, rule, k: df.select(F.lit(rule).alias("rule"), F.col(k).cast("string").alias("key"))
    found = []
    for name, k, other in FOREIGN_KEYS:
        found.append(missing_keys(tables[name], k, tables[other], "id", f"{name}.{k}"))
        if k not in OPTIONAL:
            found.append(row(tables[name].where(F.col(k).isNull()), f"{name}.{k} null", "id"))
    ids = None
    for df in tables.values():
        ids = df.select("id") if ids is None else ids.union(df.select("id"))
    found.append(row(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate id", "id"))
    leases = tables["leases"].select(F.col("id").alias("leaseId"), F.col("tenantId").alias("t"), F.col("propertyId").alias("p"))
    both = tables["maintenance_requests"].join(leases, "leaseId")
    found += [row(both.where("tenantId <> t"), "tenant differs from the lease's", "id"), row(both.where("propertyId <> p"), "property differs from the lease's", "id")]
    signal = tables["maintenance_requests"].agg(F.count("*").alias("n"), F.count("requiresApprovalOwnerId").alias("k"))
    found.append(signal.where("k = 0 or k = n").select(F.lit("approval says nothing").alias("rule"), F.col("k").cast("string").alias("key")))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _named(df: DataFrame, key: str, other: DataFrame, column: str, name: str, how: str = "inner") -> DataFrame:
    return df.join(other.select(F.col("id").alias(key), F.col(column).alias(name)), key, how)


def resolve_properties(tables: dict[str, DataFrame]) -> DataFrame:
    """Properties with their owner's name; ids are gone."""
    return _named(tables["properties"], "ownerId", tables["owners"], "name", "ownerName").drop("ownerId", "id")


def resolve_leases(tables: dict[str, DataFrame], batch: int | None = None) -> DataFrame:
    """Leases with names for keys and, where the renewal is in the same batch of ``batch`` consecutive leases, a summary of it."""
    out = tables["leases"]
    for key, other, name in (("ownerId", "owners", "ownerName"), ("tenantId", "tenants", "tenantName"), ("negotiatingAgentId", "agents", "negotiatingAgentName")):
        out = _named(out, key, tables[other], "name", name)
    numbered = tables["leases"].select("id", "startDate")
    if batch:
        numbered = batches(numbered, "id", batch)
        out = out.join(numbered.select("id", "batch"), "id")
    later = numbered.select(F.col("id").alias("amendmentLeaseId"), F.col("startDate").alias("_from"), *([F.col("batch")] if batch else []))
    out = out.join(later, ["amendmentLeaseId", "batch"] if batch else ["amendmentLeaseId"], "left")
    return out.withColumn("amendmentSummary", F.concat(F.lit("renews into a new term starting "), F.col("_from"))).drop("id", "ownerId", "tenantId", "propertyId", "negotiatingAgentId", "amendmentLeaseId", "_from")


def resolve_requests(tables: dict[str, DataFrame]) -> DataFrame:
    """Requests with names and addresses for keys; vendor and approving owner may be absent."""
    out = tables["maintenance_requests"]
    for key, other, column, name, how in (
        ("tenantId", "tenants", "name", "tenantName", "inner"), ("propertyId", "properties", "address", "propertyAddress", "inner"), ("assigningAgentId", "agents", "name", "assigningAgentName", "inner"),
        ("resolvingVendorId", "vendors", "name", "resolvingVendorName", "left"), ("requiresApprovalOwnerId", "owners", "name", "approvalNeededFromOwnerName", "left"),
    ):
        out = _named(out, key, tables[other], column, name, how)
    return out.drop("id", "tenantId", "propertyId", "leaseId", "assigningAgentId", "resolvingVendorId", "requiresApprovalOwnerId")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with batch: consecutive rows by key, ``size`` to a batch, the last one short. Numbers the keys alone, by the
    rows of the ranges before, so no task holds more than a range."""
    ranged = written(df.select(key).repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + F.col("_before")
    numbered = ranged.join(F.broadcast(before), "_part").withColumn("batch", F.floor(place / size).cast("long")).select(key, "batch")
    return df.join(numbered, key)


def batch_prompts(df: DataFrame, template: str, avoid: list[str], placeholder: str = "{{RECORDS}}") -> DataFrame:
    """df(batch, ...) -> (id, prompt): a prompt for each batch with its records as JSON and the names not to be used."""
    if placeholder not in template:
        raise ValueError(f"the template has no {placeholder}")
    columns = [c for c in df.columns if c != "batch"]
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    body = F.array_join(F.array_sort(F.collect_list(record)), ",\n")
    filled = F.replace(F.lit(template), F.lit("{{NAMES}}"), F.lit(", ".join(avoid)))
    return df.groupBy("batch").agg(body.alias("body")).select(F.col("batch").alias("id"), F.replace(filled, F.lit(placeholder), F.concat(F.lit("["), F.col("body"), F.lit("]"))).alias("prompt"))


def pairing(key: Column, pairs: tuple[str, ...] = ("tenant-agent", "agent-vendor"), seed: int = 42) -> Column:
    """Who writes to whom, picked from the key: the same in every run."""
    return F.element_at(F.array(*map(F.lit, pairs)), (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(pairs))) + 1).cast("int"))


def record_prompts(df: DataFrame, key: str, template: str, placeholders: dict[str, str]) -> DataFrame:
    """df -> (id, prompt), a prompt for each row: each placeholder of the template is filled from the named column (as
    JSON if it is a struct, "null (not assigned)" if it is null)."""
    prompt = F.lit(template)
    for placeholder, column in placeholders.items():
        if placeholder not in template:
            raise ValueError(f"the template has no {placeholder}")
        value = F.to_json(column) if df.schema[column].dataType.typeName() == "struct" else F.col(column).cast("string")
        prompt = F.replace(prompt, F.lit(placeholder), F.coalesce(value, F.lit("null (not assigned)")))
    return df.select(F.col(key).alias("id"), prompt.alias("prompt"))


def table_from_json(text: str | None) -> tuple[str | None, str | None]:
    """(CSV, None) of a response {"columns": [...], "rows": [[...], ...]}, fenced or not; else (None, why not)."""
    body = re.sub(r"\A```(?:json)?\s*|\s*```\Z", "", (text or "").strip())
    try:
        found = json.loads(body)
    except ValueError as e:
        return None, f"not JSON: {e}"
    if not isinstance(found, dict) or not {"columns", "rows"} <= found.keys():
        return None, "columns or rows are missing"
    columns, rows = found["columns"], found["rows"]
    if not isinstance(columns, list) or not isinstance(rows, list):
        return None, "columns and rows have to be lists"
    if not columns:
        return None, "no columns"
    wrong = [k for k, r in enumerate(rows) if not isinstance(r, list) or len(r) != len(columns)]
    if wrong:
        return None, f"{len(wrong)} rows without {len(columns)} cells, the first: {wrong[:5]}"
    out = io.StringIO()
    csv.writer(out).writerows([columns, *rows])
    return out.getvalue(), None


def tables_from_json(responses: DataFrame) -> DataFrame:
    """responses(id, response) -> (id, csv, error)."""

    def run(batches):
        for b in batches:
            made = [table_from_json(t) for t in b["response"]]
            yield pd.DataFrame({"id": b["id"], "csv": [m[0] for m in made], "error": [m[1] for m in made]})

    return responses.select("id", "response").mapInPandas(run, f"id {responses.schema['id'].dataType.simpleString()}, csv string, error string")


def make_documents(prompts: DataFrame, kind: str, client: Callable[[str], str], path: str, check: Callable | None = None, attempts: int = 3, force: bool = False) -> DataFrame:
    """Documents of prompts(id, prompt), appended to the table at ``path`` (kind, id, text); returns (kind, outcome, n).

    Ids that the table has are skipped unless ``force``. ``check(text)`` gives (text, None) or (None, reason); a text that
    fails it is asked for again, up to ``attempts`` times. Failed ids are left out, so a later run tries them again."""

    def run(batches):
        for b in batches:
            rows = []
            for i, prompt in zip(b["id"], b["prompt"]):
                text = error = None
                for _ in range(attempts):
                    try:
                        text, error = client(prompt), None
                    except Exception as e:
                        text, error = None, str(e)
                    if error is None and check is not None:
                        text, error = check(text)
                    if error is None:
                        break
                rows.append((kind, i, text, error))
            yield pd.DataFrame(rows, columns=["kind", "id", "text", "error"])

    spark, id_kind = prompts.sparkSession, prompts.schema["id"].dataType.simpleString()
    have = None
    if exists(spark, path):
        have = spark.read.parquet(path).where(F.col("kind") == kind).select("id").distinct()
    todo = prompts if have is None or force else prompts.join(have, "id", "left_anti")
    made = written(todo.select("id", "prompt").mapInPandas(run, f"kind string, id {id_kind}, text string, error string"))
    good = made.where("error is null").select("kind", "id", "text")
    if force and have is not None:
        old = written(spark.read.parquet(path).join(good.select("kind", "id"), ["kind", "id"], "left_anti"))
        written(old.union(good)).write.mode("overwrite").parquet(path)
    else:
        append_new(good, path, ["kind", "id"])
    done = made.select(F.when(F.col("error").isNull(), "generated").otherwise("failed").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))
    n_all, n_todo = prompts.count(), todo.count() if not force else prompts.count()
    skipped = spark.createDataFrame([("skipped", n_all - n_todo)], "outcome string, n long")
    return done.union(skipped).select(F.lit(kind).alias("kind"), "outcome", "n")
