"""Repository, metadata and citation tables as views over the driver tables.

The texts run unchanged in Spark and in DuckDB; `{name}` stands for an input table.
Each view covers its whole input tables.  Keys shared in pairs give ids and records
that occur more than once at every scale.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspan import fixed_values as fixed

ITEM_TITLE = """case
    when o_orderkey % 389 = 0 then null
    when o_orderkey % 397 = 0 then 'Short title'
    when o_orderkey % 401 = 0 then 'Title "' || o_orderpriority || '"' || chr(10) || ' no ' || cast(o_orderkey % 1201 as string)
    else 'Title ' || o_orderpriority || ' no ' || cast(o_orderkey % 1201 as string) end"""

META_TITLE = """case
    when o_orderkey % 397 = 0 then 'Short title'
    when o_orderkey % 401 = 0 then 'Title ''' || o_orderpriority || ''' no ' || cast(o_orderkey % 1201 as string)
    else 'Title ' || o_orderpriority || ' no ' || cast(o_orderkey % 1201 as string) end"""

TYPE_CODE = """case
    when o_orderkey % 997 = 0 then null when o_custkey % 7 = 0 then 35 when o_custkey % 7 = 1 then 41
    when o_custkey % 7 = 2 then 42 when o_custkey % 7 = 3 then 49 when o_custkey % 7 = 4 then 50
    when o_custkey % 7 = 5 then 57 else 58 end"""

# Labels of the type codes used above.
LABELS = {
    35: "1.01 Articolo in rivista",
    41: "2.01 Capitolo / saggio in libro",
    42: "2.02 Prefazione",
    49: "3.01 Monografia / trattato scientifico in forma di libro",
    50: "3.02 Curatela",
    57: "4.01 Contributo in Atti di convegno",
    58: "4.02 Riassunto (Abstract)",
}

_LABEL_CASES = " ".join(f"when {code} then '{label}'" for code, label in LABELS.items())
_MAPPING_ROWS = ", ".join(
    f"({'null' if a is None else repr(a)}, '{b}')" for a, b in fixed.TYPE_MAPPING
)

VIEWS = {
    "fx_master": f"""
        select o_orderkey as ITEM_ID, code as OWNING_COLLECTION,
            case code {_LABEL_CASES} end as OWNING_COLLECTION_DES,
            case when o_orderkey % 211 = 0 then 9999 when o_orderkey % 53 = 0 then null
                else cast(extract(year from o_orderdate) as int) end as DATE_ISSUED_YEAR,
            title as TITLE
        from (select o_orderkey, o_orderdate, cast({TYPE_CODE} as int) as code, {ITEM_TITLE} as title
            from {{orders}}) m""",
    "fx_identifier": """
        select o_orderkey as ITEM_ID,
            case when o_orderkey % 31 = 0 then 'n/a' when o_orderkey % 3 = 0 then 'https://doi.org/10.' ||
                cast(1000 + o_orderkey % 3 as string) || '/AbC.' || cast(o_orderkey - o_orderkey % 6 as string) ||
                '; see note' end as IDE_DOI,
            case when o_orderkey % 52 = 1 then 'ISBN 12345' when o_orderkey % 44 = 1 then 'ISBN 978-88-1-' || lpad(cast(o_orderkey - o_orderkey % 8 as string), 6, '0') || '-X'
                when o_orderkey % 4 = 1 then '88-1-' || lpad(cast(o_orderkey - o_orderkey % 8 as string), 6, '0') || '-X' end as IDE_ISBN,
            case when o_orderkey % 35 = 0 then 'PMC' || cast(o_orderkey as string)
                when o_orderkey % 5 = 0 then 'PMID: 00' || cast(10 + o_orderkey - o_orderkey % 10 as string) end as IDE_PMID
        from {orders}""",
    "fx_description": """
        select o_orderkey as ITEM_ID,
            case when o_orderkey % 41 = 0 then null
                when o_orderkey % 2 = 0 then 'ROSSI, M; Customer ' || cast(o_custkey % 17 as string)
                else 'Rossi, M; customer ' || cast(o_custkey % 17 as string) end as DES_ALLPEOPLE,
            cast(1 + o_custkey % 5 as int) as DES_NUMBEROFAUTHORS
        from {orders}""",
    "fx_publisher": """
        select o_orderkey as ITEM_ID, c_mktsegment as PUB_NAME, r_name as PUB_PLACE,
            case when o_orderkey % 9 = 0 then null else n_name end as PUB_COUNTRY
        from {orders} left join {customer} on o_custkey = c_custkey
            left join {nation} on c_nationkey = n_nationkey
            left join {region} on n_regionkey = r_regionkey""",
    "fx_language": """
        select distinct l_orderkey as ITEM_ID,
            case l_returnflag when 'A' then 'ita' when 'N' then 'eng' end as LAN_ISO
        from {lineitem}""",
    "fx_meta": f"""
        select 'omid:br/06' || cast(o_orderkey as string) ||
                case when o_orderkey % 2 <> 0 and o_custkey % 2 <> 1 then '' else
                    case when o_orderkey % 3 = 0 then ' doi:10.' || cast(1000 + o_orderkey % 3 as string) || '/abc.' ||
                        cast(o_orderkey - o_orderkey % 6 as string) else '' end ||
                    case when o_orderkey % 5 = 0 then ' pmid:' || cast(10 + o_orderkey - o_orderkey % 10 as string) else '' end ||
                    case when o_orderkey % 4 = 1 then ' isbn:881' || lpad(cast(o_orderkey - o_orderkey % 8 as string), 6, '0') || 'x' else '' end
                end as id,
            {META_TITLE} as title,
            case when o_orderkey % 8 = 0 then '' when o_orderkey % 8 in (3, 6) then 'book chapter' else 'journal article' end as type,
            case when o_orderkey % 50 = 0 then null when o_orderkey % 77 = 0 then '9999'
                else cast(cast(extract(year from o_orderdate) as int) as string) || '-01' end as pub_date
        from {{orders}}""",
    "fx_publication": f"""
        select 'omid:br/06' || cast(o_orderkey as string) as doc_id, {META_TITLE} as title,
            'Rossi' as family_1, case when o_orderkey % 7 <> 0 then 'M' end as given_1,
            case when o_orderkey % 41 <> 0 then cast(o_custkey % 17 as string) end as family_2, 'Customer' as given_2,
            case when o_orderkey % 3 = 0 then '10.' || cast(1000 + o_orderkey % 3 as string) || '/abc.' ||
                cast(o_orderkey - o_orderkey % 6 as string) end as doi,
            case when o_orderkey % 5 <> 0 then '1234-' || lpad(cast(o_custkey % 10000 as string), 4, '0') end as issn
        from {{orders}}""",
    "fx_index": """
        select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as id,
            'omid:br/06' || cast(l_orderkey as string) as citing,
            'omid:br/06' || cast(l_partkey * 7 as string) as cited
        from {lineitem}""",
    "fx_mapping": f"select iris_type, meta_type from (values {_MAPPING_ROWS}) t(iris_type, meta_type)",
}

SOURCE_TABLES = {
    "fx_master": ("orders",),
    "fx_identifier": ("orders",),
    "fx_description": ("orders",),
    "fx_publisher": ("orders", "customer", "nation", "region"),
    "fx_language": ("lineitem",),
    "fx_meta": ("orders",),
    "fx_publication": ("orders",),
    "fx_index": ("lineitem",),
}


class Inputs(dict):
    """The views under the names of the engine's inputs, opened when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables = {}

    def __missing__(self, name: str) -> DataFrame:
        if name == "publications":
            self[name] = self._publications()
            return self[name]
        view = f"fx_{name}"
        sources = {table: self.table(table) for table in SOURCE_TABLES[view]}
        self[name] = self.spark.sql(VIEWS[view], **sources)
        return self[name]

    def _publications(self) -> DataFrame:
        """Publications with their authors as a list of names."""
        names = [F.struct(F.col(f"given_{k}").alias("given"), F.col(f"family_{k}").alias("family")) for k in (1, 2)]
        return self["publication"].select("doc_id", "title", F.array(*names).alias("authors"), "doi", "issn")

    def table(self, name: str) -> DataFrame:
        """One of the driver's tables as it is."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]


def common_table_expressions() -> str:
    """All views as the head of a SQL query over the driver's tables."""
    tables = ("orders", "lineitem", "customer", "nation", "region")
    named = {t: t for t in tables}
    return ",\n".join(f"{name} as ({text.format(**named)})" for name, text in VIEWS.items())
