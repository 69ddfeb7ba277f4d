"""The fixture projections as SQL common table expressions for DuckDB."""

CUSTOMERS = """
customers AS (
 SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS ecgkey,
  CASE WHEN c_custkey % 29 = 28 THEN NULL
       WHEN c_custkey % 10 = 9 THEN CAST(c_custkey - 1 AS VARCHAR)
       ELSE CAST(c_custkey AS VARCHAR) END AS meternumber,
  CAST(700000000 + c_nationkey * 1000000 + c_custkey - c_custkey % 100 AS VARCHAR) AS accountnumber,
  CASE WHEN c_custkey % 53 = 52 THEN NULL
       ELSE 'Customer#' || lpad(CAST(c_nationkey * 1000000 + c_custkey - c_custkey % 100 AS VARCHAR), 9, '0') END AS fullname,
  '02' || lpad(CAST((c_nationkey * 1000000 + c_custkey - c_custkey % 100) % 100000000 AS VARCHAR), 8, '0') AS phonenumber,
  lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS regioncode, r_name AS regionname,
  CASE WHEN c_custkey % 97 = 96 THEN NULL
       ELSE lpad(CAST(r_regionkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS districtcode,
  n_name AS districtname,
  CASE WHEN c_custkey % 3 = 0 THEN 'Postpaid' ELSE 'Prepaid' END AS servicetype,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Residential' ELSE 'NonResidential' END AS serviceclass,
  'SPN-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS servicepointnumber,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Commercial' WHEN c_mktsegment = 'MACHINERY' THEN 'Industrial'
       ELSE 'Domestic' END AS customertype,
  CASE WHEN c_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS contractstatus,
  CASE WHEN c_custkey % 5 = 0 THEN 'Terminated' ELSE 'Live' END AS cmscontractstatus,
  CASE c_custkey % 3 WHEN 0 THEN 'MMS-WASION' WHEN 1 THEN 'Gamma' ELSE 'Landis' END AS metermake,
  CASE c_custkey % 5 WHEN 0 THEN 'ZMD410' WHEN 1 THEN 'E650' WHEN 2 THEN 'dds26d' WHEN 3 THEN 'DTSY-100'
       ELSE NULL END AS metermodel,
  CASE WHEN c_custkey % 2 = 0 THEN 'Smart' ELSE 'Conventional' END AS metertype,
  CASE WHEN c_custkey % 11 = 0 THEN 'Government' ELSE 'Private' END AS accounttype,
  c_mktsegment AS tariffclassname,
  'House ' || CAST(c_custkey % 200 + 1 AS VARCHAR) || ', ' || n_name AS address,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'Street ' || CAST(c_custkey % 50 AS VARCHAR) END AS streetname,
  CAST(c_custkey % 200 + 1 AS VARCHAR) AS housenumber,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 420 AS DOUBLE) / 100 - 3 END AS latitude,
  CASE WHEN c_custkey % 4 IN (0, 1) AND c_custkey % 8 <> 1 THEN NULL
       ELSE CAST((c_custkey * 53) % 600 AS DOUBLE) / 100 + 5 END AS longitude,
  CAST(c_custkey % 1000 AS DOUBLE) / 10 AS lastbillamount,
  c_acctbal AS currentbalance,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 700 AS DOUBLE) / 10 END AS lastpaymentamount,
  CAST('2023-01-01' AS DATE) + CAST(c_custkey % 365 AS INTEGER) AS lastpaymentdate
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

TAMPER_EVENTS = """
tamper_events AS (
 SELECT substr(CAST(ts AS VARCHAR), 1, 19) AS period, CAST(user_id AS VARCHAR) AS meter_number,
  'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS customer_name,
  CASE event_type WHEN 'error' THEN '3.26.38.98' WHEN 'click' THEN '3.26.38.99' ELSE '3.12.0.1' END AS event_code,
  'STDEVT:' || event_type AS event_desc, ts AS event_time,
  CASE WHEN k < 30 THEN NULL ELSE CAST(k AS DOUBLE) / 100 - 1 END AS latitude,
  CASE WHEN k < 20 THEN NULL ELSE CAST(k AS DOUBLE) / 50 + 5 END AS longitude,
  CAST(NULL AS BIGINT) AS counting, event_id
 FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events) e
)"""
