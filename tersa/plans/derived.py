"""Inputs derived from the given tables by SQL both engines run unchanged.

``{name}`` stands for a base table; Spark binds it to a frame, the oracle to the
view of that name.
"""

CRM = """
WITH b AS (
  SELECT c_custkey AS k, c_acctbal,
         CASE WHEN c_custkey % 16 = 0 AND c_custkey > 0 THEN c_custkey - 1 ELSE c_custkey END AS j,
         CASE WHEN c_custkey % 32 = 0 AND c_custkey > 0 THEN c_custkey - 1 ELSE c_custkey END AS t
  FROM {customer}),
n AS (
  SELECT *, (k * 7919) % 10000000000 AS ba, (k * 104729 + 12345) % 10000000000 AS bb FROM b),
m AS (
  SELECT *, 98 - (((ba % 97) * 62 + (bb % 97) * 27 + 16) % 97) AS cd FROM n)
SELECT k AS row_id,
  concat(split_part('Talleres,Construcciones,Panadería,Asesoría,Transportes,Distribuciones,Informática,Reformas,Clínica,Gestoría', ',', CAST(j % 10 + 1 AS INT)), ' ',
         split_part('Gómez,Rodríguez,Fernández,López,Martínez,Sánchez,Pérez,García,Muñoz,Peña,Ruiz,Díaz', ',', CAST(CAST((j - j % 10) / 10 AS BIGINT) % 12 + 1 AS INT)), ' ',
         CASE WHEN k % 16 = 0 THEN 'SOCIEDAD LIMITADA' WHEN k % 5 = 0 THEN 'SL' WHEN k % 5 = 1 THEN 'SLU' ELSE 'S.L.' END) AS company,
  CASE WHEN k % 29 = 0 THEN 'TEST' WHEN k % 29 = 1 THEN 'aaaa' WHEN k % 29 = 2 THEN ''
       WHEN k % 3 = 0 THEN 'MARIA DEL CARMEN RUIZ' WHEN k % 3 = 1 THEN 'ana  de la torre' ELSE 'Luis Paz' END AS name,
  concat(lpad(CAST(t * 37 AS STRING), 8, '0'),
         substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(((t * 37) % 23 + CASE WHEN t % 11 = 0 THEN 1 ELSE 0 END) % 23 + 1 AS INT), 1)) AS tax_id,
  CASE WHEN k % 13 = 0 THEN concat('ES', lpad(CAST(cd AS STRING), 2, '0'), lpad(CAST(ba AS STRING), 10, '0'), lpad(CAST((bb + 1) % 10000000000 AS STRING), 10, '0'))
       WHEN k % 13 = 1 THEN ''
       ELSE concat('ES', lpad(CAST(cd AS STRING), 2, '0'), lpad(CAST(ba AS STRING), 10, '0'), lpad(CAST(bb AS STRING), 10, '0')) END AS iban,
  CASE k % 17 WHEN 0 THEN '' WHEN 1 THEN concat('no_email', CAST(k AS STRING), '.com')
       WHEN 2 THEN concat('info', CAST(k AS STRING), '@gmail.con') WHEN 3 THEN concat('info', CAST(k AS STRING), '@mailinator.com')
       WHEN 4 THEN concat('INFO', CAST(k AS STRING), '@EMPRESA.ES') ELSE concat('info', CAST(k AS STRING), '@empresa.es') END AS email,
  CASE WHEN k % 190 = 0 THEN '111111111' WHEN k % 19 = 1 THEN lpad(CAST(k AS STRING), 5, '0')
       WHEN k % 19 = 2 THEN concat('+34 6', lpad(CAST(k AS STRING), 8, '0')) WHEN k % 19 = 3 THEN ''
       ELSE concat('6', lpad(CAST(k AS STRING), 8, '0')) END AS phone,
  CASE WHEN j % 23 = 0 AND j % 52 + 1 < 10 THEN concat(CAST(j % 52 + 1 AS STRING), lpad(CAST(j % 1000 AS STRING), 3, '0'))
       WHEN j % 23 = 0 THEN '99999'
       ELSE concat(lpad(CAST(j % 52 + 1 AS STRING), 2, '0'), lpad(CAST(j % 1000 AS STRING), 3, '0')) END AS postal_code,
  CASE WHEN k % 37 = 0 THEN NULL WHEN k % 31 = 0 THEN 150 ELSE CAST(k % 100 AS INT) END AS age,
  c_acctbal * 30 AS income
FROM m
"""

def _digit(number: str, place: int) -> str:
    return f"CAST(floor({number} / {10 ** place}) AS BIGINT) % 10"


def _cif_control(number: str) -> str:
    """Control digit of a seven-digit company number."""
    odd = [f"(CASE WHEN {d} < 5 THEN 2 * ({d}) ELSE 2 * ({d}) - 9 END)"
           for d in (_digit(number, p) for p in (6, 4, 2, 0))]
    even = [f"({_digit(number, p)})" for p in (5, 3, 1)]
    return f"CAST((10 - ({' + '.join(odd + even)}) % 10) % 10 AS BIGINT)"


def _nif_letter(number: str) -> str:
    return f"substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(({number}) % 23 + 1 AS INT), 1)"


_SEVEN = "lpad(CAST(n AS STRING), 7, '0')"

# Every outcome of every check: letters of foreigners and companies, prefixes and
# separators, unknown countries, fillers, missing and misplaced numbers.
EDGES = f"""
WITH b AS (SELECT c_custkey AS k, (c_custkey * 7919 + 1234567) % 10000000 AS n FROM {{customer}}),
c AS (SELECT *, {_cif_control("n")} AS cd FROM b)
SELECT k AS row_id,
  CASE k % 18 WHEN 0 THEN '' WHEN 1 THEN concat({_SEVEN}, 'Z') WHEN 2 THEN 'ÑÑÑÑÑÑÑÑÑ'
    WHEN 3 THEN concat('X', {_SEVEN}, {_nif_letter("n")})
    WHEN 4 THEN concat('Y', {_SEVEN}, {_nif_letter("n + 10000000")})
    WHEN 5 THEN concat('Z', {_SEVEN}, {_nif_letter("n + 20000001")})
    WHEN 6 THEN concat('B', {_SEVEN}, CAST(cd AS STRING))
    WHEN 7 THEN concat('A', {_SEVEN}, CAST((cd + 1) % 10 AS STRING))
    WHEN 8 THEN concat('Q', {_SEVEN}, substr('JABCDEFGHI', CAST(cd + 1 AS INT), 1))
    WHEN 9 THEN concat('Q', {_SEVEN}, CAST(cd AS STRING))
    WHEN 10 THEN concat('C', {_SEVEN}, CAST(cd AS STRING))
    WHEN 11 THEN concat('D', {_SEVEN}, substr('JABCDEFGHI', CAST(cd + 1 AS INT), 1))
    WHEN 12 THEN concat('es0', {_SEVEN}, {_nif_letter("n")})
    WHEN 13 THEN concat('0.', {_SEVEN}, '-', {_nif_letter("n")}, ' ')
    WHEN 14 THEN ' n/a ' WHEN 15 THEN concat({_SEVEN}, '12345')
    WHEN 16 THEN concat('0', {_SEVEN}, {_nif_letter("n + 1")})
    ELSE concat('0', {_SEVEN}, {_nif_letter("n")}) END AS tax_id,
  split_part('|1234|ESXX2100041845|ES91210004184502000513|ES91 2100 0418 4502 0005 1332|AE070331234567890123456|DE89370400440532013000|GB29NWBK60161331926819|FR1420041010050500013M02606|es9121000418450200051332|ES9121000418450200051333|ES91-2100-0418-4502-0005-1332|AE070331234567890123457', '|', CAST(k % 13 + 1 AS INT)) AS iban,
  split_part('|test@test.com|sin@arroba|dos@@arrobas.com|x@gmail.con|y@mailinator.com|  UP@EMPRESA.ES  |n/a|no_email.com|a.b+c@sub.dominio.com', '|', CAST(k % 10 + 1 AS INT)) AS email,
  split_part('|abc|---|111111111|12345|0034600123456|+34 912 34 56 78|600123456.0|60012345678901|nan|600-123-456', '|', CAST(k % 11 + 1 AS INT)) AS phone,
  split_part('|1001|28001.0|99999|123456|53001| 28001 |08001|null|abc', '|', CAST(k % 10 + 1 AS INT)) AS postal_code,
  split_part('TEST|aaaa||JUAN DE LA TORRE|Ana Paz|pedro3|maria  del mar', '|', CAST(k % 7 + 1 AS INT)) AS name,
  split_part('TEST|  Talleres   Paz  |Paz SL||Obras 2000 SA', '|', CAST(k % 5 + 1 AS INT)) AS company,
  CASE WHEN k % 50 = 0 THEN NULL WHEN k % 49 = 0 THEN -1 WHEN k % 47 = 0 THEN 119 ELSE CAST(40 + k % 7 AS INT) END AS age,
  CASE WHEN k % 50 = 1 THEN NULL WHEN k % 49 = 1 THEN -5.0 WHEN k % 47 = 1 THEN 9000000.0 ELSE 30000.0 + k % 900 END AS income
FROM c
"""

# Identifiers that reached the table as numbers, and columns that leave the usual
# spread undefined.
TYPED = """
SELECT c_custkey AS row_id, CAST(600000000 + (c_custkey * 7919) % 99999999 AS DOUBLE) AS phone,
  CAST(c_custkey * 37 % 60000 AS INT) AS postal_code, CAST(42 AS DOUBLE) AS fixed_value,
  CASE WHEN c_custkey % 20 = 0 THEN CAST(c_custkey % 7 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS tied,
  CAST(NULL AS DOUBLE) AS nothing,
  CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(c_custkey AS STRING) END AS worded
FROM {customer}
"""

# Names one or two letters apart inside blocks of a few dozen rows, one block
# holding a third of all suppliers' parts, for the similarity operators.
NAMES = """
SELECT p_partkey AS row_id,
  CASE WHEN p_partkey % 3 = 0 THEN '28001' ELSE concat('0', CAST(1000 + p_partkey % 89 AS STRING)) END AS postal_code,
  concat(split_part('Talleres,Construcciones,Distribuciones,Transportes', ',', CAST(p_partkey % 4 + 1 AS INT)), ' ',
         split_part('Gomez,Gomes,Gonzalez,Gonzales,Fernandez,Hernandez,Fernandes,Martinez,Martin', ',', CAST(p_partkey % 9 + 1 AS INT)), ' ',
         split_part('Norte,Norte,Sur,Levante,Poniente', ',', CAST(p_partkey % 5 + 1 AS INT)), ' ',
         split_part('del Rio,del Mar,y Asociados,y Asociadas,Hermanos,Hermanas,e Hijos', ',', CAST(p_partkey % 7 + 1 AS INT)),
         CASE WHEN p_partkey % 2 = 0 THEN ' S.L.' ELSE ' SL' END) AS company
FROM {part}
"""

BILLING = """
SELECT event_id, ts,
  CASE WHEN event_type = 'purchase' OR event_id % 3 <> 0 THEN concat('org_', CAST(user_id % 40 AS STRING)) END AS org_id,
  CASE WHEN event_id % 11 = 0 THEN concat('org_', CAST(user_id % 40 AS STRING)) END AS client_reference_id,
  CASE WHEN event_id % 10 <> 9 THEN concat('cus_', CAST(user_id % 40 AS STRING), '_', CAST(CAST((event_id - event_id % 2500) / 2500 AS BIGINT) % 4 AS STRING)) END AS customer,
  concat('sub_', CAST(user_id % 40 AS STRING), '_', CAST(event_id % 6 AS STRING)) AS object_id,
  CASE WHEN event_id % 5 = 0 THEN 'payment' ELSE 'subscription' END AS mode,
  CASE WHEN event_id % 2 = 0 THEN concat('sub_', CAST(user_id % 40 AS STRING), '_c') END AS subscription,
  CASE WHEN event_id % 6 = 1 THEN '1' END AS trial,
  CASE event_type WHEN 'click' THEN 'customer.subscription.updated' WHEN 'view' THEN 'invoice.payment_failed'
       WHEN 'purchase' THEN 'checkout.session.completed' WHEN 'error' THEN 'customer.subscription.deleted' ELSE 'charge.refunded' END AS type,
  CASE WHEN event_type = 'error' THEN 'canceled' WHEN event_id % 7 = 0 THEN 'past_due' ELSE 'active' END AS status,
  CASE event_id % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' WHEN 2 THEN 'scale' ELSE NULL END AS plan_meta,
  CASE event_id % 5 WHEN 0 THEN 2900 WHEN 1 THEN 9900 WHEN 2 THEN 39900 WHEN 3 THEN 1234 ELSE NULL END AS unit_amount,
  CASE WHEN event_id % 3 = 1 THEN ts END AS period_end,
  event_id % 13 = 0 AS cancel_at_period_end,
  CAST(event_id % 4 AS INT) AS attempt_count
FROM {events}
"""

RUNS = """
SELECT o_orderkey AS run_id, concat('org_', CAST(o_custkey % 40 AS STRING)) AS org_id,
  o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS rows_in,
  CASE o_custkey % 40 % 5 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' WHEN 2 THEN 'scale' WHEN 3 THEN 'legacy' ELSE 'free' END AS plan
FROM {orders}
"""

FIELDS = {
    c: c for c in (
        "company", "name", "tax_id", "iban", "email", "phone", "postal_code", "age", "income")
}
