"""The domain's tables as projections of the driver's TPC-H-like tables, as DataFrames and as SQL (``VIEWS``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.operators import alerts, core, score

REF_DATE = "2024-02-01"
KEY = "salt"


class Domain:
    """Lazy views of one data directory; derived tables are built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.ref_date = spark, sf_dir, REF_DATE

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _once(self, name, make):
        if name not in self.__dict__:
            self.__dict__[name] = make()
        return self.__dict__[name]

    @property
    def suppliers(self):
        return self._once("_suppliers", self._make_suppliers)

    def _make_suppliers(self):
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        k = F.col("s_suppkey")
        root = F.lpad(k.cast("string"), 8, "0")
        return s.select(
            k.alias("pk_fornecedor"),
            F.concat(root, F.lit("000100")).alias("cnpj"),
            root.alias("cnpj_basico"),
            F.col("s_name").alias("razao_social"),
            (F.col("s_acctbal") * 10).cast("decimal(18,2)").alias("capital_social"),
            F.date_add(F.lit("1993-10-01").cast("date"), ((k * 37) % 800).cast("int")).alias("data_abertura"),
            F.when(k % 3 == 0, "6201-5").when(k % 3 == 1, "4120-4").otherwise("8121-4").alias("cnae_principal"),
            F.concat(F.lit("Rua "), F.col("n_name"), F.lit(", "), F.floor(k / 40).cast("string")).alias("logradouro"),
            F.when(k % 4 == 1, F.lit(0).cast("long")).when(k % 4 == 0, F.lit(None).cast("long")).otherwise(k).alias("qtd_funcionarios"),
            F.col("n_name").alias("uf"),
        )

    @property
    def contracts(self):
        return self._once("_contracts", self._make_contracts)

    def _make_contracts(self):
        """Every line of every order; an order is a bid (one in eleven has no number), and some suppliers' lines are
        worth ten times as much from 1998 on. Values and days are cut to cents and dates before they are shuffled."""
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_shipdate").cast("date").alias("shipped"))
        bids = self.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ordered"))
        bids = bids.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))  # first, so that lines are not shuffled by customer
        kind = F.when(F.col("p_type").startswith("ECONOMY"), "SAUDE").when(F.col("p_type").startswith("SMALL"), "LIMPEZA").when(F.col("p_type").startswith("MEDIUM"), "CONSTRUCAO").when(F.col("p_type").startswith("PROMO"), "TECNOLOGIA")
        part = self.table("part").select("p_partkey", "p_name", kind.alias("kind"))
        j = line.join(bids, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        words = F.when(F.col("l_partkey") % 97 == 5, F.lit("software de ")).when(F.col("l_partkey") % 97 == 6, F.lit("obra de ")).otherwise(F.lit(""))
        value = F.col("price") * F.when((F.col("l_suppkey") % 9 == 4) & (F.year("ordered") >= 1998), 10).otherwise(1)
        return j.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pk_contrato"),
            F.col("l_suppkey").alias("fk_fornecedor"),
            F.when(F.col("l_suppkey") % 7 == 0, F.lit(1)).otherwise(F.col("c_nationkey")).cast("long").alias("fk_orgao"),
            F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("LIC-"), F.col("o_orderkey").cast("string"))).alias("num_licitacao"),
            value.cast("decimal(18,2)").alias("valor"),
            F.col("ordered").alias("data_assinatura"),
            F.col("shipped").alias("data_vigencia"),
            F.col("kind").alias("objeto_categoria"),
            F.concat(F.lpad(F.col("l_suppkey").cast("string"), 8, "0"), F.lit("/0001-00")).alias("cnpj_fornecedor"),
            F.concat(words, F.col("p_name")).alias("objeto"),
        )

    @property
    def yearly(self):
        """One aggregation of the contracts that all indicators share, kept for the session."""
        return self._once("_yearly", lambda: core.yearly(self.contracts).persist())

    @property
    def yearly_online(self):
        """The same for the online indicators, which infer the category."""
        return self._once("_yearly_online", lambda: core.yearly(self.contracts, online=True).persist())

    @property
    def per_supplier(self):
        """One aggregation that all rules share, kept for the session; of ``yearly`` if there are indicators."""
        return self._once("_per_supplier", lambda: core.per_supplier(self.yearly if "_yearly" in self.__dict__ else self.contracts).persist())

    @property
    def sanctions(self):
        def make():
            """Every error event; a user stands for fourteen companies."""
            e = self.table("events").filter("event_type = 'error'")
            k = F.col("user_id") * 14 + F.col("event_id") % 14
            root, start = F.lpad(k.cast("string"), 8, "0"), F.date_sub(F.col("ts").cast("date"), 45)
            end = F.when(F.col("event_id") % 3 != 0, F.date_add(start, F.floor("value").cast("int")))
            return e.select(F.col("event_id").alias("pk_sancao"), k.alias("fk_fornecedor"), root.alias("cnpj_basico"), F.concat(root, F.lit("000100")).alias("cnpj"), F.concat(F.lit("EMPRESA "), k.cast("string")).alias("razao_social"), F.when(F.col("event_id") % 2 == 0, "CNEP").otherwise("CEIS").alias("tipo_sancao"), start.alias("data_inicio"), end.alias("data_fim"))

        return self._once("_sanctions", make)

    @property
    def donations(self):
        def make():
            """Every purchase event: of a company, or (one in three) of a partner."""
            e = self.table("events").filter("event_type = 'purchase'")
            person, k = F.col("event_id") % 3 == 0, F.col("user_id") * 14 + F.col("event_id") % 14
            return e.select(F.col("event_id").alias("pk_doacao"), F.when(~person, k).alias("fk_fornecedor"), F.when(person, k * 2).alias("fk_socio"), (F.col("value") * 200).cast("decimal(18,2)").alias("valor"), F.when(person, "CPF").otherwise("CNPJ").alias("tipo_doador"), F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit("000100")).alias("doc_doador"), F.year("ts").alias("ano_eleicao"))

        return self._once("_donations", make)

    @property
    def raw_partners(self):
        def make():
            """Two partners a supplier; names are shared by up to four neighbours in the keys, whatever the scale."""
            k = F.col("pk_fornecedor")
            first = F.when(k % 3 != 0, F.floor(k / 4)).otherwise(10_000_000 + k)
            second = F.when(k % 2 == 0, 20_000_000 + F.floor(k / 7)).otherwise(30_000_000 + k)
            p = self.suppliers.select(k, "cnpj_basico", F.posexplode(F.array(first.cast("long"), second.cast("long"))).alias("j", "n"))
            digits = F.lpad((F.col("n") % 1_000_000).cast("string"), 6, "0")
            return p.select((k * 2 + F.col("j")).alias("pk_socio"), k.alias("fk_fornecedor"), "cnpj_basico", F.concat(F.lit("SOCIO "), F.col("n").cast("string")).alias("nome_socio"), F.concat(F.lit("***"), digits, F.lit("**")).alias("cpf_parcial"))

        return self._once("_raw_partners", make)

    @property
    def bridge(self):
        return self.raw_partners.select("fk_fornecedor", F.col("pk_socio").alias("fk_socio"))

    @property
    def servants(self):
        def make():
            """Every customer; the digits of those of one nation in three are those of the partner of the same name."""
            k = F.col("c_custkey")
            digits = F.lpad(((k + F.when(F.col("c_nationkey") % 3 == 0, 0).otherwise(1)) % 1_000_000).cast("string"), 6, "0")
            return self.table("customer").select(F.concat(F.lit("SOCIO "), k.cast("string")).alias("nome"), digits.alias("digitos_visiveis"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("orgao_lotacao"))

        return self._once("_servants", make)

    @property
    def partners(self):
        return self._once("_partners", lambda: core.enrich_partners(core.match_servants(self.raw_partners, self.servants), self.suppliers, self.sanctions, self.ref_date))

    @property
    def scores(self):
        return self._once("_scores", lambda: score.all_indicators(self.suppliers, self.partners, self.contracts, self.sanctions, self.ref_date, yearly=self.yearly, per=self.per_supplier))

    @property
    def scores_online(self):
        def make():
            by_year = self.yearly_online
            per = self._once("_per_supplier", lambda: core.per_supplier(by_year).persist())
            return score.all_indicators(self.suppliers, self.partners, self.contracts, self.sanctions, self.ref_date, "online", yearly=by_year, per=per)

        return self._once("_scores_online", make)

    @property
    def alerts(self):
        return self._once("_alerts", lambda: alerts.all_alerts(self.suppliers, self.partners, self.contracts, self.sanctions, self.donations, self.ref_date, self.per_supplier))

    @property
    def dimension(self):
        return self._once("_dimension", lambda: core.denormalise(self.suppliers, self.scores, self.alerts, self.per_supplier))

    @property
    def agencies(self):
        return self._once("_agencies", lambda: self.table("nation").select(F.col("n_nationkey").cast("long").alias("pk_orgao"), F.concat(F.lit("ORG"), F.col("n_nationkey").cast("string")).alias("codigo"), F.col("n_name").alias("nome")))


VIEWS = """
supplier_v AS (
  SELECT s_suppkey AS pk_fornecedor, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '000100' AS cnpj, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS cnpj_basico,
    s_name AS razao_social, CAST(s_acctbal * 10 AS DECIMAL(18,2)) AS capital_social, DATE '1993-10-01' + CAST((s_suppkey * 37) % 800 AS INTEGER) AS data_abertura,
    CASE s_suppkey % 3 WHEN 0 THEN '6201-5' WHEN 1 THEN '4120-4' ELSE '8121-4' END AS cnae_principal,
    'Rua ' || n_name || ', ' || CAST(s_suppkey // 40 AS VARCHAR) AS logradouro,
    CASE s_suppkey % 4 WHEN 1 THEN 0 WHEN 0 THEN NULL ELSE s_suppkey END AS qtd_funcionarios, n_name AS uf
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
contract_v AS (
  SELECT l_orderkey * 10 + l_linenumber AS pk_contrato, l_suppkey AS fk_fornecedor,
    CAST(CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE c_nationkey END AS BIGINT) AS fk_orgao,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'LIC-' || CAST(o_orderkey AS VARCHAR) END AS num_licitacao,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_suppkey % 9 = 4 AND year(o_orderdate) >= 1998 THEN 10 ELSE 1 END AS DECIMAL(18,2)) AS valor,
    CAST(o_orderdate AS DATE) AS data_assinatura, CAST(l_shipdate AS DATE) AS data_vigencia,
    CASE WHEN starts_with(p_type, 'ECONOMY') THEN 'SAUDE' WHEN starts_with(p_type, 'SMALL') THEN 'LIMPEZA' WHEN starts_with(p_type, 'MEDIUM') THEN 'CONSTRUCAO'
      WHEN starts_with(p_type, 'PROMO') THEN 'TECNOLOGIA' END AS objeto_categoria,
    lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || '/0001-00' AS cnpj_fornecedor,
    CASE l_partkey % 97 WHEN 5 THEN 'software de ' WHEN 6 THEN 'obra de ' ELSE '' END || p_name AS objeto
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
sanction_v AS (
  SELECT event_id AS pk_sancao, user_id * 14 + event_id % 14 AS fk_fornecedor, lpad(CAST(user_id * 14 + event_id % 14 AS VARCHAR), 8, '0') AS cnpj_basico,
    lpad(CAST(user_id * 14 + event_id % 14 AS VARCHAR), 8, '0') || '000100' AS cnpj, 'EMPRESA ' || CAST(user_id * 14 + event_id % 14 AS VARCHAR) AS razao_social,
    CASE WHEN event_id % 2 = 0 THEN 'CNEP' ELSE 'CEIS' END AS tipo_sancao, CAST(ts AS DATE) - 45 AS data_inicio,
    CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) - 45 + CAST(floor(value) AS INTEGER) END AS data_fim
  FROM events WHERE event_type = 'error'),
donation_v AS (
  SELECT event_id AS pk_doacao, CASE WHEN event_id % 3 <> 0 THEN user_id * 14 + event_id % 14 END AS fk_fornecedor,
    CASE WHEN event_id % 3 = 0 THEN (user_id * 14 + event_id % 14) * 2 END AS fk_socio, CAST(value * 200 AS DECIMAL(18,2)) AS valor,
    CASE WHEN event_id % 3 = 0 THEN 'CPF' ELSE 'CNPJ' END AS tipo_doador, lpad(CAST(user_id * 14 + event_id % 14 AS VARCHAR), 8, '0') || '000100' AS doc_doador,
    CAST(year(ts) AS INTEGER) AS ano_eleicao
  FROM events WHERE event_type = 'purchase'),
raw_partner_v AS (
  SELECT pk_fornecedor * 2 + j AS pk_socio, pk_fornecedor AS fk_fornecedor, cnpj_basico, 'SOCIO ' || CAST(n AS VARCHAR) AS nome_socio,
    '***' || lpad(CAST(n % 1000000 AS VARCHAR), 6, '0') || '**' AS cpf_parcial
  FROM (
    SELECT pk_fornecedor, cnpj_basico, 0 AS j, CASE WHEN pk_fornecedor % 3 <> 0 THEN pk_fornecedor // 4 ELSE 10000000 + pk_fornecedor END AS n FROM supplier_v
    UNION ALL SELECT pk_fornecedor, cnpj_basico, 1, CASE WHEN pk_fornecedor % 2 = 0 THEN 20000000 + pk_fornecedor // 7 ELSE 30000000 + pk_fornecedor END FROM supplier_v)),
servant_v AS (
  SELECT 'SOCIO ' || CAST(c_custkey AS VARCHAR) AS nome,
    lpad(CAST((c_custkey + CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE 1 END) % 1000000 AS VARCHAR), 6, '0') AS digitos_visiveis,
    CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS orgao_lotacao
  FROM customer),
live_v AS (SELECT * FROM sanction_v WHERE data_fim IS NULL OR data_fim > DATE '2024-02-01'),
partner_v AS (
  SELECT p.*, s.orgao_lotacao, s.nome IS NOT NULL AS is_servidor_publico, b.cnpj_basico IS NOT NULL AS is_sancionado,
    b.cnpj_basico AS sancionado_cnpj_basico, b.razao_social AS sancionado_razao_social, q.n AS qtd_empresas_governo
  FROM raw_partner_v p LEFT JOIN servant_v s ON s.nome = p.nome_socio AND s.digitos_visiveis = substr(p.cpf_parcial, 4, 6)
  LEFT JOIN (SELECT cnpj_basico, min(razao_social) AS razao_social FROM live_v GROUP BY 1) b ON b.cnpj_basico = p.cnpj_basico
  JOIN (SELECT nome_socio, count(DISTINCT cnpj_basico) AS n FROM raw_partner_v GROUP BY 1) q USING (nome_socio)),
agency_v AS (SELECT CAST(n_nationkey AS BIGINT) AS pk_orgao, 'ORG' || CAST(n_nationkey AS VARCHAR) AS codigo, n_name AS nome FROM nation)
"""
