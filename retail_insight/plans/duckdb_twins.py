"""Independent SQL statements of the registered queries (DuckDB dialect).

They restate each query's semantics directly in SQL over the raw driver
tables (whole tables, plain window functions for ranks), so a value-hash
match checks the Spark operators rather than a shared code path. Only the
constant dimension data (segment names, icons, colours, playbook text) is
rendered from the library's constant tables. Shared CTEs are composed as
text.
"""

from __future__ import annotations

from retail_insight.operators import segments as seg
from retail_insight.operators import value as val


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(col: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {col} {arms} END"


def _order(names) -> str:
    return f"CAST(list_position([{', '.join(map(_q, names))}], Segment) - 1 AS INTEGER)"


def _values(rows, names) -> str:
    body = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(names)}))"


SEG_DIM = _values([(n, i) for i, n in enumerate(seg.SEGMENTS)], ["Segment", "SegmentOrder"])
LEGACY_DIM = _values([(n, i) for i, n in enumerate(seg.LEGACY_SEGMENTS)], ["Segment", "SegmentOrder"])
TIER_DIM = _values([(t, i) for i, t in enumerate(val.TIERS)], ["Churn_Risk_Tier", "TierOrder"])

# -------------------------------------------------------------- transactions
LINES = """
lines AS (
  SELECT * FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p   ON l.l_partkey = p.p_partkey
)"""

TX_ORDERS = LINES + """,
raw_tx AS (
  SELECT CAST(o_custkey AS VARCHAR)                       AS CustomerID,
         CAST(o_orderkey AS VARCHAR)                      AS InvoiceNo,
         o_orderdate                                      AS PurchaseDate,
         round_even(l_extendedprice * (1 - l_discount), 2) AS TotalSpend,
         l_quantity                                       AS Quantity,
         l_extendedprice / nullif(l_quantity, 0)          AS UnitPrice,
         p_name                                           AS Product,
         p_type                                           AS ProductCategory
  FROM lines
),
tx AS (
  SELECT trim(CustomerID) AS CustomerID, InvoiceNo, PurchaseDate, TotalSpend,
         coalesce(Quantity, 1.0) AS Quantity, coalesce(UnitPrice, 0.0) AS UnitPrice,
         Product, ProductCategory
  FROM raw_tx
  WHERE CustomerID IS NOT NULL AND PurchaseDate IS NOT NULL AND TotalSpend IS NOT NULL
    AND trim(CustomerID) NOT IN ('', 'nan', 'None')
    AND TotalSpend > 0 AND coalesce(Quantity, 1.0) > 0
)"""

TX_EVENTS = """
tx AS (
  SELECT CAST(user_id AS VARCHAR) AS CustomerID, CAST(event_id AS VARCHAR) AS InvoiceNo,
         ts AS PurchaseDate, value AS TotalSpend, 1.0::DOUBLE AS Quantity,
         coalesce(value, 0.0) / 1.0 AS UnitPrice, 'Catalog Product' AS Product,
         event_type AS ProductCategory
  FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND value > 0
)"""

DIRTY_RAW = LINES + """,
dirty AS (
  SELECT CASE WHEN l_orderkey % 17 = 0 THEN NULL
              WHEN l_orderkey % 23 = 0 THEN 'nan'
              WHEN l_linenumber = 2 THEN '  ' || CAST(o_custkey AS VARCHAR) || ' '
              ELSE CAST(o_custkey AS VARCHAR) END AS cust_txt,
         CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
         CASE WHEN l_orderkey % 19 = 0 THEN 'not a date'
              ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS date_txt,
         CASE WHEN l_orderkey % 29 = 0 THEN 'n/a'
              WHEN l_linenumber = 7 THEN CAST(-round_even(l_extendedprice * (1 - l_discount), 2) AS VARCHAR)
              ELSE CAST(round_even(l_extendedprice * (1 - l_discount), 2) AS VARCHAR) END AS amount_txt,
         CASE WHEN l_orderkey % 13 = 0 THEN NULL
              WHEN l_orderkey % 31 = 0 THEN '0'
              ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty_txt,
         p_type AS Dept, p_name AS Item
  FROM lines
),
dirty_typed AS (
  SELECT trim(cust_txt) AS CustomerID, InvoiceNo,
         try_strptime(trim(date_txt), '%Y-%m-%d %H:%M:%S') AS PurchaseDate,
         TRY_CAST(amount_txt AS DOUBLE) AS TotalSpend,
         coalesce(TRY_CAST(qty_txt AS DOUBLE), 1.0) AS Quantity,
         Item AS Product, Dept AS ProductCategory
  FROM dirty
),
tx AS (
  SELECT CustomerID, InvoiceNo, PurchaseDate, TotalSpend, Quantity,
         coalesce(TotalSpend, 0.0) / CASE WHEN Quantity = 0 THEN 1.0 ELSE Quantity END AS UnitPrice,
         Product, ProductCategory
  FROM dirty_typed
  WHERE CustomerID IS NOT NULL AND PurchaseDate IS NOT NULL AND TotalSpend IS NOT NULL
    AND CustomerID NOT IN ('', 'nan', 'None') AND TotalSpend > 0 AND Quantity > 0
)"""

MAPPED_TX = LINES + """,
tx AS (
  SELECT trim(CAST(o_custkey AS VARCHAR)) AS CustomerID, CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
         o_orderdate AS PurchaseDate, l_extendedprice AS TotalSpend, 1.0::DOUBLE AS Quantity,
         coalesce(l_extendedprice, 0.0) / 1.0 AS UnitPrice, 'Catalog Product' AS Product,
         p_brand AS ProductCategory
  FROM lines
  WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND l_extendedprice IS NOT NULL
    AND trim(CAST(o_custkey AS VARCHAR)) NOT IN ('', 'nan', 'None') AND l_extendedprice > 0
)"""

PICKER_TX = LINES + """,
tx AS (
  SELECT trim(CAST(o_custkey AS VARCHAR)) AS CustomerID, CAST(l_orderkey AS VARCHAR) AS InvoiceNo,
         o_orderdate AS PurchaseDate, l_extendedprice AS TotalSpend, 1.0::DOUBLE AS Quantity,
         coalesce(l_extendedprice, 0.0) / 1.0 AS UnitPrice, 'Catalog Product' AS Product,
         p_brand AS ProductCategory
  FROM lines
  WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND l_extendedprice IS NOT NULL
    AND trim(CAST(o_custkey AS VARCHAR)) NOT IN ('', 'nan', 'None') AND l_extendedprice > 0
)"""

UNPRICED_TX = LINES + """,
tx AS (
  SELECT trim(CAST(o_custkey AS VARCHAR)) AS CustomerID, CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
         o_orderdate AS PurchaseDate,
         round_even(coalesce(l_quantity, 1.0) * coalesce(l_extendedprice / nullif(l_quantity, 0), 0.0), 2)
           AS TotalSpend,
         coalesce(l_quantity, 1.0) AS Quantity,
         coalesce(l_extendedprice / nullif(l_quantity, 0), 0.0) AS UnitPrice,
         'Catalog Product' AS Product, p_type AS ProductCategory
  FROM lines
  WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
    AND trim(CAST(o_custkey AS VARCHAR)) NOT IN ('', 'nan', 'None')
    AND round_even(coalesce(l_quantity, 1.0) * coalesce(l_extendedprice / nullif(l_quantity, 0), 0.0), 2) > 0
    AND coalesce(l_quantity, 1.0) > 0
)"""

UNINVOICED_TX = """
tx AS (
  SELECT CAST(user_id AS VARCHAR) AS CustomerID, CAST(row_number() OVER () AS VARCHAR) AS InvoiceNo,
         ts AS PurchaseDate, value AS TotalSpend, 1.0::DOUBLE AS Quantity,
         coalesce(value, 0.0) / 1.0 AS UnitPrice, 'Catalog Product' AS Product,
         'General Merchandise' AS ProductCategory
  FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND value > 0
)"""

RETAIL_RAW = LINES + """,
retail_raw AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' || CAST(o_orderkey AS VARCHAR)
              ELSE CAST(o_orderkey AS VARCHAR) END AS InvoiceNo,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE p_name || ' ' END AS Description,
         CAST(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT)
                   ELSE CAST(l_quantity AS BIGINT) END AS VARCHAR) AS Quantity,
         strftime(o_orderdate, '%-m/%-d/%Y %-H:%M') AS InvoiceDate,
         CAST(l_extendedprice / nullif(l_quantity, 0) AS VARCHAR) AS UnitPrice,
         CASE WHEN c.c_acctbal < 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS CustomerID,
         n.n_name AS Country
  FROM lines JOIN customer c ON o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
),
retail_typed AS (
  SELECT *, coalesce(CAST(trunc(TRY_CAST(Quantity AS DOUBLE)) AS BIGINT), 0) AS q,
         coalesce(TRY_CAST(UnitPrice AS DOUBLE), 0.0) AS pr,
         try_strptime(trim(InvoiceDate), '%m/%d/%Y %H:%M') AS ts,
         coalesce(starts_with(InvoiceNo, 'C'), false) AS cancelled
  FROM retail_raw
)"""

# -------------------------------------------------------------- features
FEATURES = """
cust_agg AS (
  SELECT CustomerID, min(PurchaseDate) AS FirstPurchase, max(PurchaseDate) AS LastPurchase,
         count(DISTINCT InvoiceNo) AS Frequency,
         CAST(sum(CAST(round_even(TotalSpend * 1000000, 0) AS BIGINT)) AS DOUBLE) / 1e6 AS spend,
         sum(Quantity) AS TotalItems, count(InvoiceNo) AS TotalTransactions
  FROM tx GROUP BY CustomerID
),
cat_spend AS (
  SELECT CustomerID, ProductCategory,
         sum(CAST(round_even(TotalSpend * 1000000, 0) AS BIGINT)) AS w
  FROM tx WHERE ProductCategory IS NOT NULL GROUP BY CustomerID, ProductCategory
),
top_cat AS (
  SELECT CustomerID, ProductCategory AS TopCategory FROM (
    SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY w DESC, ProductCategory ASC) AS rn
    FROM cat_spend) WHERE rn = 1
),
snap AS (SELECT max(LastPurchase) + INTERVAL 1 DAY AS s FROM cust_agg),
features AS (
  SELECT a.CustomerID, a.FirstPurchase, a.LastPurchase, a.Frequency,
         round_even(a.spend, 2) AS Monetary, a.TotalItems, a.TotalTransactions,
         CAST(greatest(date_sub('day', a.LastPurchase, snap.s), 0) AS INTEGER) AS Recency,
         CAST(greatest(date_sub('day', a.FirstPurchase, snap.s), 1) AS INTEGER) AS Tenure,
         round_even(round_even(a.spend, 2) / greatest(a.Frequency, 1), 2) AS AvgOrderValue,
         coalesce(t.TopCategory, 'General Merchandise') AS TopCategory
  FROM cust_agg a CROSS JOIN snap LEFT JOIN top_cat t USING (CustomerID)
)"""


def _score(rank: str, q: int) -> str:
    # pd.qcut of the ranks 1..n: the edges are the interpolated j/q quantiles
    # 1 + (n - 1) * j / q, and a rank's bin is the number of edges below it,
    # at least 1.
    below = " + ".join(f"(({rank} - 1) * {q} > {j} * (n_ - 1))::INTEGER" for j in range(q))
    return f"CAST(CASE WHEN n_ < {q} THEN {q} ELSE greatest(1, {below}) END AS INTEGER)"


def _account_tx(account: str) -> str:
    return LINES + f""",
tx AS (
  SELECT trim(CAST({account} AS VARCHAR)) AS CustomerID, CAST(o_orderkey AS VARCHAR) AS InvoiceNo, o_orderdate AS PurchaseDate,
         round_even(l_extendedprice * (1 - l_discount), 2) AS TotalSpend, coalesce(l_quantity, 1.0) AS Quantity,
         p_type AS ProductCategory
  FROM lines WHERE {account} IS NOT NULL AND o_orderdate IS NOT NULL
    AND round_even(l_extendedprice * (1 - l_discount), 2) > 0 AND coalesce(l_quantity, 1.0) > 0
)"""


def _gap_tx(missing: str) -> str:
    return LINES + f""",
tx AS (
  SELECT CAST(o_custkey AS VARCHAR) AS CustomerID,
         coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END, {missing}) AS InvoiceNo, o_orderdate AS PurchaseDate,
         round_even(l_extendedprice * (1 - l_discount), 2) AS TotalSpend, 1.0::DOUBLE AS Quantity,
         coalesce(CASE WHEN l_linenumber <> 2 THEN p_type END, {missing}) AS ProductCategory
  FROM lines WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND round_even(l_extendedprice * (1 - l_discount), 2) > 0
)"""


SEGMENT_CASE = """CASE
    WHEN Tenure <= 65 AND R_Score >= 4 AND F_Score <= 2 THEN 'New Customers'
    WHEN (R_Score >= 4 AND F_Score >= 4 AND M_Score >= 4) OR (R_Score = 5 AND F_Score >= 3 AND M_Score >= 4) THEN 'Champions'
    WHEN R_Score = 1 AND (F_Score >= 4 OR M_Score >= 4) THEN 'Can''t Lose Them'
    WHEN R_Score <= 2 AND (M_Score >= 3 OR F_Score >= 3) THEN 'At-Risk VIPs'
    WHEN (R_Score >= 4 AND F_Score <= 3) OR (R_Score >= 3 AND M_Score >= 4) THEN 'Potential Growth'
    WHEN (R_Score >= 3 AND F_Score >= 3) OR (R_Score >= 2 AND F_Score >= 4 AND M_Score >= 3) THEN 'Loyalists'
    ELSE 'Hibernating' END"""

SCORES = f"""
ranked AS (
  SELECT f.*, count(*) OVER () AS n_,
         row_number() OVER (ORDER BY Recency DESC, CustomerID ASC) AS rr_,
         row_number() OVER (ORDER BY Frequency ASC, CustomerID ASC) AS rf_,
         row_number() OVER (ORDER BY Monetary ASC, CustomerID ASC) AS rm_,
         row_number() OVER (ORDER BY Tenure ASC, CustomerID ASC) AS rt_
  FROM features f
),
scored AS (
  SELECT * EXCLUDE (n_, rr_, rf_, rm_, rt_),
         {_score('rr_', 5)} AS R_Score, {_score('rf_', 5)} AS F_Score,
         {_score('rm_', 5)} AS M_Score, {_score('rt_', 5)} AS T_Score
  FROM ranked
),
segmented AS (
  SELECT *, CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Score,
         round_even((R_Score + F_Score + M_Score + T_Score) / 4.0, 2) AS RFMT_Mean,
         {SEGMENT_CASE} AS Segment
  FROM scored
),
customers AS (
  SELECT *, {_order(seg.SEGMENTS)} AS Segment_Order, {_case('Segment', seg.SEGMENT_ICONS)} AS Segment_Icon,
            {_case('Segment', seg.SEGMENT_COLORS)} AS Segment_Color
  FROM segmented
)"""


def _valued_cte(horizon: float = 90.0, margin: float = 0.35) -> str:
    return f"""
v0 AS (
  SELECT *, CAST(Recency AS DOUBLE) AS r_, CAST(Frequency AS DOUBLE) AS f_, CAST(Tenure AS DOUBLE) AS t_
  FROM customers
),
v1 AS (
  SELECT *, (f_ + 1.2::DOUBLE) / (t_ + 60.0::DOUBLE) AS rate_,
         r_ / greatest(t_ / greatest(f_, 1.0::DOUBLE), 7.0::DOUBLE) AS missed_,
         r_ / greatest(t_, 1.0::DOUBLE) AS inactive_
  FROM v0
),
v2 AS (
  SELECT *, least(greatest(1.0::DOUBLE / (1.0::DOUBLE + exp(least(greatest(
            1.4::DOUBLE * (missed_ - 1.8::DOUBLE) + 1.2::DOUBLE * (inactive_ - 0.4::DOUBLE),
            -10.0::DOUBLE), 10.0::DOUBLE))), 0.02::DOUBLE), 0.99::DOUBLE) AS p_
  FROM v1
),
valued AS (
  SELECT * EXCLUDE (r_, f_, t_, rate_, missed_, inactive_, p_),
         round_even(p_, 4) AS P_Alive,
         round_even(p_ * 100.0::DOUBLE, 1) AS P_Alive_Pct,
         round_even((1.0::DOUBLE - p_) * 100.0::DOUBLE, 1) AS Churn_Risk_Pct,
         CASE WHEN round_even(p_, 4) >= 0.75 THEN {_q(val.TIER_LOW)}
              WHEN round_even(p_, 4) >= 0.45 THEN {_q(val.TIER_MODERATE)}
              ELSE {_q(val.TIER_HIGH)} END AS Churn_Risk_Tier,
         round_even(p_ * rate_ * {horizon}::DOUBLE, 2) AS Expected_Orders_90d,
         round_even(p_ * rate_ * {horizon}::DOUBLE * AvgOrderValue, 2) AS Predicted_Spend_90d,
         round_even(p_ * rate_ * {horizon}::DOUBLE * AvgOrderValue * {margin}::DOUBLE, 2) AS Predictive_CLV_90d
  FROM v2
)"""


VALUED = _valued_cte()

SUMMARY_SELECT = f"""
per_seg AS (
  SELECT Segment, count(*) AS n_, sum(CAST(round_even(Monetary * 1e6, 0) AS BIGINT)) AS rev_,
         sum(Recency) AS rec_, sum(Frequency) AS freq_, sum(Tenure) AS ten_,
         sum(CAST(round_even(AvgOrderValue * 1e6, 0) AS BIGINT)) AS aov_
  FROM customers GROUP BY Segment
),
summary AS (
  SELECT d.Segment, d.SegmentOrder, coalesce(p.n_, 0) AS CustomerCount,
         CAST(coalesce(p.rev_, 0) AS DOUBLE) / 1e6 AS TotalRevenue,
         round_even(CAST(p.rev_ AS DOUBLE) / 1e6 / p.n_, 2) AS AvgRevenue,
         round_even(CAST(p.rec_ AS DOUBLE) / p.n_, 1) AS AvgRecency,
         round_even(CAST(p.freq_ AS DOUBLE) / p.n_, 1) AS AvgFrequency,
         round_even(CAST(p.ten_ AS DOUBLE) / p.n_, 1) AS AvgTenure,
         round_even(CAST(p.aov_ AS DOUBLE) / 1e6 / p.n_, 2) AS AvgAOV
  FROM {SEG_DIM} d LEFT JOIN per_seg p USING (Segment)
),
summary2 AS (
  SELECT * EXCLUDE (SegmentOrder),
         round_even(CustomerCount / greatest(sum(CustomerCount) OVER (), 1) * 100.0, 1) AS CustomerSharePct,
         round_even(TotalRevenue / greatest(sum(TotalRevenue) OVER (), 1.0) * 100.0, 1) AS RevenueSharePct
  FROM summary
)"""


def _quantile_sql(q: float) -> str:
    if q == 0.5:
        return "(SELECT median(Monetary) FROM valued)"
    return f"(SELECT quantile_cont(Monetary, {q}) FROM valued)"


COHORT = """
cm AS (SELECT DISTINCT CustomerID, CAST(date_trunc('month', PurchaseDate) AS DATE) AS OrderMonth
       FROM tx WHERE CustomerID IS NOT NULL AND PurchaseDate IS NOT NULL),
cm2 AS (SELECT *, min(OrderMonth) OVER (PARTITION BY CustomerID) AS CohortStart FROM cm),
cm3 AS (SELECT *, CAST((year(OrderMonth) - year(CohortStart)) * 12 + (month(OrderMonth) - month(CohortStart))
                       AS INTEGER) AS CohortIndex FROM cm2),
cells AS (SELECT CohortStart, CohortIndex, count(*) AS ActiveCustomers FROM cm3
          WHERE CohortIndex >= 0 GROUP BY CohortStart, CohortIndex),
sized AS (SELECT *, max(CASE WHEN CohortIndex = 0 THEN ActiveCustomers END)
                      OVER (PARTITION BY CohortStart) AS CohortSize FROM cells),
keep AS (SELECT CohortIndex FROM (SELECT CohortIndex, dense_rank() OVER (ORDER BY CohortIndex) AS pos
                                 FROM (SELECT DISTINCT CohortIndex FROM cells)) WHERE pos <= 13),
retention AS (
  SELECT strftime(CohortStart, '%Y-%m') AS CohortMonth, CohortIndex, ActiveCustomers, CohortSize,
         round_even(least(greatest(CASE WHEN CohortIndex = 0 THEN 100.0::DOUBLE
                                        ELSE ActiveCustomers / CohortSize * 100.0::DOUBLE END,
                                   0.0::DOUBLE), 100.0::DOUBLE), 1) AS RetentionPct
  FROM sized
),
shown AS (SELECT * FROM retention WHERE CohortIndex IN (SELECT CohortIndex FROM keep))"""

SEG_STATS = f"""
seg_per AS (
  SELECT Segment, count(*) AS n_, sum(CAST(round_even(AvgOrderValue * 1e6, 0) AS BIGINT)) AS aov_
  FROM valued GROUP BY Segment
),
seg_stats AS (
  SELECT d.Segment, d.SegmentOrder, coalesce(p.n_, 0) AS SegmentCustomers,
         coalesce(CAST(p.aov_ AS DOUBLE) / 1e6 / p.n_, 150.0::DOUBLE) AS seg_aov
  FROM {SEG_DIM} d LEFT JOIN seg_per p USING (Segment)
)"""


def _roi_cols(reach: str, budget: str, conv: str, margin: str) -> str:
    aud = f"CAST(floor(SegmentCustomers * ({reach} / 100.0::DOUBLE)) AS BIGINT)"
    convs = f"({aud} * ({conv} / 100.0::DOUBLE))"
    gross = f"({convs} * seg_aov)"
    profit = f"({gross} * ({margin} / 100.0::DOUBLE))"
    net = f"({profit} - {budget})"
    return f"""{aud} AS Audience, round_even(seg_aov, 2) AS AvgSegmentAOV,
         round_even({convs}, 2) AS ProjectedConversions, round_even({gross}, 2) AS ProjectedRevenue,
         round_even({profit}, 2) AS GrossProfit, round_even({net}, 2) AS NetProfit,
         round_even({net} / greatest({budget}, 1.0::DOUBLE) * 100.0::DOUBLE, 1) AS ROIPct,
         round_even({budget} / greatest({convs}, 1.0::DOUBLE), 2) AS CostPerConversion"""


def _playbook_values() -> str:
    rows = [(r[0], r[7], r[8], r[9], r[10][0], r[11][0], r[11][3]) for r in seg.playbook_rows()]
    return _values(rows, ["pb_seg", "Strategic_Objective", "Recommended_Channel", "Recommended_Promotion",
                          "Primary_Action_Item", "Campaign_Email_Subject", "Campaign_CTA"])


LEGACY = """
legacy_tx AS (
  SELECT CAST(o_custkey AS VARCHAR) AS CustomerID, CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
         o_orderdate AS PurchaseDate,
         coalesce(round_even(l_extendedprice * (1 - l_discount), 2),
                  round_even(coalesce(l_quantity, 1.0) * coalesce(l_extendedprice / nullif(l_quantity, 0), 0.0), 2))
           AS TotalSpend,
         coalesce(l_quantity, 1.0) AS Quantity, p_name AS Product
  FROM lines WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
),
l_agg AS (
  SELECT CustomerID, min(PurchaseDate) AS FirstPurchase, max(PurchaseDate) AS LastPurchase,
         count(DISTINCT InvoiceNo) AS Frequency,
         CAST(sum(CAST(round_even(TotalSpend * 1000000, 0) AS BIGINT)) AS DOUBLE) / 1e6 AS spend,
         sum(Quantity) AS TotalItems, count(InvoiceNo) AS TotalTransactions
  FROM legacy_tx GROUP BY CustomerID
),
l_prod AS (
  SELECT CustomerID, Product AS FavoriteProduct FROM (
    SELECT CustomerID, Product, row_number() OVER (PARTITION BY CustomerID ORDER BY q DESC, Product ASC) AS rn
    FROM (SELECT CustomerID, Product, sum(Quantity) AS q FROM legacy_tx GROUP BY CustomerID, Product))
  WHERE rn = 1
),
l_snap AS (SELECT max(LastPurchase) + INTERVAL 1 DAY AS s FROM l_agg),
l_feat AS (
  SELECT a.CustomerID,
         CAST(greatest(date_sub('day', a.LastPurchase, l_snap.s), 0) AS INTEGER) AS Recency,
         a.Frequency, round_even(a.spend, 2) AS Monetary, a.FirstPurchase, a.LastPurchase,
         a.TotalItems, a.TotalTransactions,
         round_even(round_even(a.spend, 2) / greatest(a.Frequency, 1), 2) AS AvgOrderValue,
         coalesce(p.FavoriteProduct, 'N/A') AS FavoriteProduct
  FROM l_agg a CROSS JOIN l_snap LEFT JOIN l_prod p USING (CustomerID)
),
l_ranked AS (
  SELECT f.*, count(*) OVER () AS n_,
         row_number() OVER (ORDER BY Recency DESC, CustomerID ASC) AS rr_,
         row_number() OVER (ORDER BY Frequency ASC, CustomerID ASC) AS rf_,
         row_number() OVER (ORDER BY Monetary ASC, CustomerID ASC) AS rm_
  FROM l_feat f
),
l_scored AS (
  SELECT * EXCLUDE (n_, rr_, rf_, rm_),
         """ + _score("rr_", 4) + """ AS R_Score, """ + _score("rf_", 4) + """ AS F_Score,
         """ + _score("rm_", 4) + """ AS M_Score
  FROM l_ranked
),
l_seg AS (
  SELECT *, CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Score,
         round_even((R_Score + F_Score + M_Score) / 3.0, 2) AS RFM_Mean,
         CASE WHEN (R_Score = 4 AND F_Score >= 3 AND M_Score >= 3) OR (R_Score >= 3 AND F_Score = 4 AND M_Score = 4)
                   OR (R_Score = 4 AND F_Score = 4) THEN 'Champions'
              WHEN (R_Score >= 3 AND F_Score >= 3) OR (R_Score >= 2 AND F_Score >= 3 AND M_Score >= 3)
                   OR (R_Score >= 3 AND M_Score >= 3) THEN 'Loyal Customers'
              WHEN R_Score >= 3 AND F_Score <= 2 THEN 'New/Promising'
              WHEN R_Score <= 2 AND (F_Score >= 2 OR M_Score >= 3) THEN 'At Risk'
              ELSE 'Lost/Inactive' END AS Segment
  FROM l_scored
),
legacy_customers AS (
  SELECT *, """ + _order(seg.LEGACY_SEGMENTS) + """ AS Segment_Order, """ + _case("Segment", seg.LEGACY_ICONS) + """ AS Segment_Icon,
            """ + _case("Segment", seg.LEGACY_COLORS) + """ AS Segment_Color
  FROM l_seg
)"""


LEGACY_DAYS = """
legacy_tx AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS CustomerID, CAST(o_orderkey AS VARCHAR) AS InvoiceNo, o_orderdate AS PurchaseDate,
         CASE WHEN l_linenumber = 3 THEN round_even(coalesce(l_quantity, 1.0) * coalesce(l_extendedprice / nullif(l_quantity, 0), 0.0), 2)
              ELSE coalesce(round_even(l_extendedprice * (1 - l_discount), 2),
                            round_even(coalesce(l_quantity, 1.0) * coalesce(l_extendedprice / nullif(l_quantity, 0), 0.0), 2)) END AS TotalSpend,
         coalesce(l_quantity, 1.0) AS Quantity, p_name AS Product
  FROM lines WHERE o_orderdate IS NOT NULL
),
""" + LEGACY[LEGACY.index("l_agg AS ("):]

LEGACY_BOOK = _values([(r[0], r[1], r[6], r[7][0], r[8][0]) for r in seg.legacy_playbook_rows()],
                      ["Segment", "SegmentOrder", "Goal", "Action", "Channel"])


RETAIL_PROFILE = """SELECT count(*) AS RawRows,
            count(*) FILTER (WHERE CustomerID IS NOT NULL) AS RowsWithCustomer,
            count(*) FILTER (WHERE CustomerID IS NOT NULL AND NOT cancelled AND q > 0 AND pr > 0) AS RowsPositive,
            count(*) FILTER (WHERE CustomerID IS NOT NULL AND NOT cancelled AND q > 0 AND pr > 0 AND ts IS NOT NULL)
              AS CleanRows,
            count(DISTINCT CASE WHEN CustomerID IS NOT NULL AND NOT cancelled AND q > 0 AND pr > 0 AND ts IS NOT NULL
                                THEN CAST(CAST(CustomerID AS BIGINT) AS VARCHAR) END) AS Customers,
            strftime(min(CASE WHEN CustomerID IS NOT NULL AND NOT cancelled AND q > 0 AND pr > 0 THEN ts END),
                     '%Y-%m-%d %H:%M:%S') AS FirstDate,
            strftime(max(CASE WHEN CustomerID IS NOT NULL AND NOT cancelled AND q > 0 AND pr > 0 THEN ts END),
                     '%Y-%m-%d %H:%M:%S') AS LastDate,
            round_even(CAST(sum(CASE WHEN CustomerID IS NOT NULL AND NOT cancelled AND q > 0 AND pr > 0
                                     AND ts IS NOT NULL
                                THEN CAST(round_even(round_even(q * pr, 2) * 1e6, 0) AS BIGINT) END) AS DOUBLE) / 1e6, 2)
              AS GrossRevenue
            FROM retail_typed"""


def _dated_tx(last_day: int) -> str:
    """Lines with text dates in one of three layouts; the column's own counts
    choose which one holds."""
    return LINES + f""",
dated AS (
  SELECT *, CASE WHEN l_orderkey % 19 = 0 THEN 'soon'
                 WHEN l_orderkey % 23 = 0 THEN strftime(day_, '%Y-%m-%d')
                 ELSE strftime(day_, '%d/%m/%Y') END AS txt
  FROM (SELECT *, make_date(year(o_orderdate), month(o_orderdate), least(day(o_orderdate), {last_day})) AS day_ FROM lines)
),
seen AS (SELECT count(try_strptime(txt, '%Y-%m-%d')) AS iso, count(try_strptime(txt, '%m/%d/%Y')) AS month_first,
                count(try_strptime(txt, '%d/%m/%Y')) AS day_first FROM dated),
read_ AS (
  SELECT d.*, CASE WHEN iso >= greatest(month_first, day_first) THEN try_strptime(txt, '%Y-%m-%d')
                   WHEN month_first >= day_first THEN try_strptime(txt, '%m/%d/%Y')
                   ELSE try_strptime(txt, '%d/%m/%Y') END AS PurchaseDate,
         round_even(l_extendedprice * (1 - l_discount), 2) AS TotalSpend
  FROM dated d CROSS JOIN seen
),
tx AS (
  SELECT CAST(o_custkey AS VARCHAR) AS CustomerID, CAST(o_orderkey AS VARCHAR) AS InvoiceNo, PurchaseDate, TotalSpend,
         1.0::DOUBLE AS Quantity, TotalSpend / 1.0 AS UnitPrice, 'Catalog Product' AS Product, p_type AS ProductCategory
  FROM read_ WHERE PurchaseDate IS NOT NULL AND TotalSpend > 0 AND o_custkey IS NOT NULL
)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n" + select


def twins() -> dict[str, str]:
    A = (TX_ORDERS, FEATURES, SCORES)
    B = (TX_EVENTS, FEATURES, SCORES)
    out = {
        "customer_features": with_ctes(TX_ORDERS, FEATURES, select="SELECT * FROM features"),
        "customer_features_events": with_ctes(TX_EVENTS, FEATURES, select="SELECT * FROM features"),
        "customer_features_dashboard_snapshot": with_ctes(TX_EVENTS, FEATURES.replace(
            "snap AS (SELECT max(LastPurchase) + INTERVAL 1 DAY AS s FROM cust_agg)",
            "snap AS (SELECT date_trunc('day', max(ts) + INTERVAL 1 DAY) AS s FROM events)"),
            select="SELECT * FROM features"),
        "customer_segments": with_ctes(*A, select="SELECT * FROM customers"),
        "customer_segments_events": with_ctes(*B, select="SELECT * FROM customers"),
        "segment_summary": with_ctes(*A, SUMMARY_SELECT, select="SELECT * FROM summary2"),
        "segment_summary_events": with_ctes(*B, SUMMARY_SELECT, select="SELECT * FROM summary2"),
        "customer_value": with_ctes(*A, VALUED, select="SELECT * FROM valued"),
        "customer_value_params": with_ctes(*B, _valued_cte(30.0, 0.5), select="SELECT * FROM valued"),
        "churn_watchlist": with_ctes(*A, VALUED, select=f"""SELECT * FROM valued
            WHERE P_Alive < 0.45 AND Monetary >= {_quantile_sql(0.5)}"""),
        "churn_watchlist_top_quartile": with_ctes(*A, VALUED, select=f"""SELECT * FROM valued
            WHERE P_Alive < 0.45 AND Monetary >= {_quantile_sql(0.75)}"""),
        "growth_targets": with_ctes(*A, VALUED, select="""SELECT * FROM valued
            ORDER BY Predicted_Spend_90d DESC, CustomerID ASC LIMIT 10"""),
        "cohort_retention": with_ctes(TX_ORDERS, COHORT, select="SELECT * FROM retention"),
        "cohort_retention_events": with_ctes(TX_EVENTS, COHORT, select="SELECT * FROM retention"),
        "cohort_sizes": with_ctes(TX_ORDERS, COHORT, select="""SELECT strftime(CohortStart, '%Y-%m') AS CohortMonth,
            count(*) AS CohortSize FROM cm3 WHERE CohortIndex = 0 GROUP BY CohortStart"""),
        "cohort_matrix": with_ctes(TX_ORDERS, COHORT, select="SELECT CohortMonth, " + ", ".join(
            f"max(CASE WHEN CohortIndex = {i} THEN RetentionPct END) AS Month_{i}" for i in range(13))
            + " FROM shown GROUP BY CohortMonth"),
        "cohort_heatmap": with_ctes(TX_ORDERS, COHORT, select="""SELECT 'Cohort ' || CohortMonth AS y_label,
            'Month ' || CAST(CohortIndex AS VARCHAR) AS x_label, CohortMonth, CohortIndex, RetentionPct,
            CAST(CAST(round_even(RetentionPct, 0) AS BIGINT) AS VARCHAR) || '%' AS text,
            ActiveCustomers, CohortSize FROM shown"""),
        "cohort_curve": with_ctes(TX_ORDERS, COHORT, select="""SELECT CohortIndex,
            round_even(CAST(sum(CAST(round_even(RetentionPct * 10, 0) AS BIGINT)) AS DOUBLE) / count(RetentionPct) / 10.0, 1)
            AS AvgRetentionPct FROM shown GROUP BY CohortIndex"""),
        "cohort_benchmarks": with_ctes(TX_ORDERS, COHORT, select="SELECT " + ", ".join(
            f"coalesce(CAST(sum(CASE WHEN CohortIndex = {m} THEN CAST(round_even(RetentionPct * 10, 0) AS BIGINT) END)"
            f" AS DOUBLE) / count(CASE WHEN CohortIndex = {m} THEN 1 END) / 10.0, 0.0) AS Month{m}RetentionPct"
            for m in (1, 3, 6)) + " FROM shown"),
        "global_kpis": with_ctes(*A, VALUED, select="""SELECT count(*) AS TotalCustomers,
            count(*) FILTER (WHERE P_Alive >= 0.5) AS ActiveCustomers,
            round_even(count(*) FILTER (WHERE P_Alive >= 0.5) / greatest(count(*), 1) * 100.0, 1) AS ActivePct,
            round_even(CAST(sum(CAST(round_even(Monetary * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6, 2) AS RealizedRevenue,
            round_even(CAST(sum(CAST(round_even(Predicted_Spend_90d * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6, 2)
              AS Forecast90dRevenue,
            round_even(CAST(sum(CAST(round_even(Predictive_CLV_90d * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6, 2)
              AS Forecast90dCLV,
            round_even(CAST(sum(Tenure) AS DOUBLE) / greatest(count(*), 1), 1) AS AvgTenureDays FROM valued"""),
        "churn_tiers": with_ctes(*A, VALUED, select=f"""SELECT d.Churn_Risk_Tier, coalesce(c.n, 0) AS Customers,
            round_even(coalesce(c.n, 0) / greatest(sum(coalesce(c.n, 0)) OVER (), 1) * 100.0, 1) AS SharePct
            FROM {TIER_DIM} d LEFT JOIN (SELECT Churn_Risk_Tier, count(*) AS n FROM valued GROUP BY 1) c
            USING (Churn_Risk_Tier)"""),
        "churn_tiers_events": with_ctes(*B, VALUED, select=f"""SELECT d.Churn_Risk_Tier, coalesce(c.n, 0) AS Customers,
            round_even(coalesce(c.n, 0) / greatest(sum(coalesce(c.n, 0)) OVER (), 1) * 100.0, 1) AS SharePct
            FROM {TIER_DIM} d LEFT JOIN (SELECT Churn_Risk_Tier, count(*) AS n FROM valued GROUP BY 1) c
            USING (Churn_Risk_Tier)"""),
        "p_alive_histogram": with_ctes(*A, VALUED, select="""SELECT Churn_Risk_Tier,
            CAST(least(floor(P_Alive_Pct / (100.0::DOUBLE / 30)), 29) AS INTEGER) AS Bin, count(*) AS Customers,
            round_even(CAST(least(floor(P_Alive_Pct / (100.0::DOUBLE / 30)), 29) AS INTEGER) * (100.0::DOUBLE / 30), 4)
              AS BinStart,
            round_even((CAST(least(floor(P_Alive_Pct / (100.0::DOUBLE / 30)), 29) AS INTEGER) + 1) * (100.0::DOUBLE / 30), 4)
              AS BinEnd
            FROM valued GROUP BY 1, 2"""),
        "revenue_rollup": with_ctes(*A, select="""SELECT Segment, CustomerID,
            CAST(sum(CAST(round_even(Monetary * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 AS Revenue,
            CAST(grouping(Segment, CustomerID) AS INTEGER) AS Level
            FROM customers GROUP BY ROLLUP (Segment, CustomerID)"""),
        "revenue_share": with_ctes(*A, SUMMARY_SELECT, select="""SELECT Segment, TotalRevenue, RevenueSharePct,
            CustomerSharePct FROM summary2"""),
        "value_scatter": with_ctes(*A, VALUED, select="""SELECT CustomerID, Segment, Monetary, Predicted_Spend_90d,
            P_Alive_Pct, Expected_Orders_90d, Predictive_CLV_90d FROM valued"""),
        "watchlist_display": with_ctes(*A, VALUED, select=f"""SELECT CustomerID, Segment,
            printf('%.1f', P_Alive_Pct) || '%' AS P_Alive_Pct, Churn_Risk_Tier,
            '$' || format('{{:,.2f}}', Monetary) AS Monetary, Frequency,
            CAST(Recency AS VARCHAR) || ' days' AS Recency, Tenure,
            '$' || format('{{:,.2f}}', AvgOrderValue) AS AvgOrderValue, TopCategory
            FROM valued WHERE P_Alive < 0.45 AND Monetary >= {_quantile_sql(0.5)}"""),
        "campaign_roi": with_ctes(*A, VALUED, SEG_STATS, select=f"""SELECT Segment, SegmentCustomers,
            {_roi_cols('80.0::DOUBLE', '3500.0::DOUBLE', '8.5::DOUBLE', '40.0::DOUBLE')},
            80.0::DOUBLE AS ReachPct, 3500.0::DOUBLE AS Budget, 8.5::DOUBLE AS ConversionPct,
            40.0::DOUBLE AS MarginPct FROM seg_stats"""),
        "roi_grid": with_ctes(*A, VALUED, SEG_STATS, select=f"""SELECT Segment, SegmentCustomers, ReachPct, Budget,
            ConversionPct, MarginPct, {_roi_cols('ReachPct', 'Budget', 'ConversionPct', 'MarginPct')}
            FROM (SELECT s.*, CAST(r.r AS DOUBLE) AS ReachPct, 3500.0::DOUBLE AS Budget,
                         1.0::DOUBLE + CAST(c.i AS DOUBLE) * 0.5::DOUBLE AS ConversionPct, 40.0::DOUBLE AS MarginPct
                  FROM seg_stats s, range(10, 101, 5) r(r), range(0, 59) c(i))"""),
        "campaign_audience": with_ctes(*A, VALUED, select="""SELECT Segment, CustomerID, AudienceRank, Monetary,
            AvgOrderValue FROM (SELECT *, row_number() OVER (PARTITION BY Segment ORDER BY CustomerID) AS AudienceRank,
            count(*) OVER (PARTITION BY Segment) AS n_ FROM valued)
            WHERE AudienceRank <= floor(n_ * 0.8)"""),
        "segment_summary_display": with_ctes(*A, SUMMARY_SELECT, select="""SELECT Segment,
            CustomerCount AS "Customers", TotalRevenue AS "Total Revenue ($)", AvgRevenue AS "Avg Spend / Cust ($)",
            AvgRecency AS "Avg Recency (Days)", AvgFrequency AS "Avg Orders", AvgTenure AS "Avg Tenure (Days)",
            AvgAOV AS "Avg AOV ($)", CustomerSharePct AS "Cust %", RevenueSharePct AS "Rev %" FROM summary2"""),
        "action_plan_core": with_ctes(*A, VALUED, select=f"""SELECT CustomerID, Segment, Churn_Risk_Tier,
            P_Alive_Pct, Churn_Risk_Pct, Recency, Frequency, Monetary, Tenure, AvgOrderValue, TopCategory,
            R_Score, F_Score, M_Score, T_Score, RFM_Score, RFMT_Mean, Expected_Orders_90d, Predicted_Spend_90d,
            Predictive_CLV_90d, coalesce(Strategic_Objective, '') AS Strategic_Objective,
            coalesce(Recommended_Channel, '') AS Recommended_Channel,
            coalesce(Recommended_Promotion, '') AS Recommended_Promotion,
            coalesce(Primary_Action_Item, '') AS Primary_Action_Item,
            coalesce(Campaign_Email_Subject, '') AS Campaign_Email_Subject,
            coalesce(Campaign_CTA, '') AS Campaign_CTA, FirstPurchase, LastPurchase, TotalItems, TotalTransactions
            FROM valued v LEFT JOIN {_playbook_values()} ON v.Segment = pb_seg"""),
        "legacy_rfm": with_ctes(LINES, LEGACY, select="SELECT * FROM legacy_customers"),
        "legacy_segment_summary": with_ctes(LINES, LEGACY, select=f"""SELECT d.Segment, coalesce(p.n_, 0) AS CustomerCount,
            CAST(coalesce(p.rev_, 0) AS DOUBLE) / 1e6 AS TotalRevenue,
            round_even(CAST(p.rev_ AS DOUBLE) / 1e6 / p.n_, 2) AS AvgRevenue,
            round_even(CAST(p.rec_ AS DOUBLE) / p.n_, 1) AS AvgRecency,
            round_even(CAST(p.freq_ AS DOUBLE) / p.n_, 1) AS AvgFrequency,
            round_even(CAST(p.aov_ AS DOUBLE) / 1e6 / p.n_, 2) AS AvgAOV,
            round_even(coalesce(p.n_, 0) / greatest(sum(coalesce(p.n_, 0)) OVER (), 1) * 100.0, 1) AS CustomerSharePct,
            round_even(CAST(coalesce(p.rev_, 0) AS DOUBLE) / 1e6
                       / greatest(sum(CAST(coalesce(p.rev_, 0) AS DOUBLE) / 1e6) OVER (), 1.0) * 100.0, 1) AS RevenueSharePct
            FROM {LEGACY_DIM} d LEFT JOIN (SELECT Segment, count(*) AS n_,
              sum(CAST(round_even(Monetary * 1e6, 0) AS BIGINT)) AS rev_, sum(Recency) AS rec_,
              sum(Frequency) AS freq_, sum(CAST(round_even(AvgOrderValue * 1e6, 0) AS BIGINT)) AS aov_
              FROM legacy_customers GROUP BY Segment) p USING (Segment)"""),
        "ingest_dirty": with_ctes(DIRTY_RAW, select="SELECT * FROM tx"),
        "ingest_custom_mapping": with_ctes(MAPPED_TX, select="SELECT * FROM tx"),
        "dirty_segments": with_ctes(DIRTY_RAW, FEATURES, SCORES, select="SELECT * FROM customers"),
        "retail_clean": with_ctes(RETAIL_RAW, select="""SELECT
            CAST(CAST(CustomerID AS BIGINT) AS VARCHAR) AS CustomerID, InvoiceNo,
            strftime(ts, '%Y-%m-%d %H:%M:%S') AS PurchaseDate, round_even(q * pr, 2) AS TotalSpend,
            q AS Quantity, pr AS UnitPrice, trim(coalesce(Description, 'Catalog Item')) AS Product,
            coalesce(Country, 'United Kingdom') AS ProductCategory
            FROM retail_typed WHERE CustomerID IS NOT NULL AND NOT cancelled AND q > 0 AND pr > 0 AND ts IS NOT NULL"""),
        "retail_profile": with_ctes(RETAIL_RAW, select=RETAIL_PROFILE),
        "transactions_profile": with_ctes(TX_ORDERS, select="""SELECT count(*) AS Transactions,
            count(DISTINCT CustomerID) AS Customers, min(PurchaseDate) AS FirstDate, max(PurchaseDate) AS LastDate,
            round_even(CAST(sum(CAST(round_even(TotalSpend * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6, 2) AS GrossRevenue
            FROM tx"""),
        "csv_records": with_ctes(LINES, select="""SELECT category AS ProductCategory, count(*) AS Lines,
            count(DISTINCT o_custkey) AS Customers, CAST(sum(CAST(round_even(spend * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 AS Spend,
            (SELECT count(*) FROM lines WHERE l_orderkey % 37 = 0) AS BadRecords
            FROM (SELECT *, p_type || CASE WHEN l_linenumber = 2 THEN ' "' || p_brand || '",' || chr(10) || 'as seen' ELSE '' END AS category,
                    round_even(l_extendedprice * (1 - l_discount), 2) AS spend FROM lines)
            WHERE l_orderkey % 37 <> 0 AND spend > 0 AND o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY category"""),
        "ingest_day_first": with_ctes(_dated_tx(31), select="SELECT * FROM tx"),
        "ingest_ambiguous_dates": with_ctes(_dated_tx(12), select="SELECT * FROM tx"),
        "invoice_numbers": """SELECT l_orderkey, l_linenumber, 'INV-' || lpad(CAST(n AS VARCHAR), greatest(6, length(CAST(n AS VARCHAR)))::INTEGER, '0') AS InvoiceNo
            FROM (SELECT l_orderkey, l_linenumber, row_number() OVER () AS n FROM lineitem)""",
        "retail_clean_counts": with_ctes(RETAIL_RAW, select="SELECT RawRows, RowsWithCustomer, RowsPositive, CleanRows, FirstDate, LastDate, GrossRevenue FROM ("
                                         + RETAIL_PROFILE + ")"),
        "customer_features_updated": with_ctes(TX_ORDERS, FEATURES, select="SELECT * FROM features"),
        "cohort_retention_merged": with_ctes(TX_ORDERS, COHORT, select="SELECT * FROM retention"),
        "export_round_trip": with_ctes(*A, select="SELECT CustomerID, Segment, Monetary, RFM_Score FROM customers"),
        "saved_model_scores": with_ctes(*A, select="""SELECT count(*) AS Customers, CAST(0 AS BIGINT) AS Moved,
            CAST(4 AS BIGINT) AS Clusters FROM customers"""),
        "zscore_features": with_ctes(TX_ORDERS, FEATURES, select="SELECT CustomerID, " + ", ".join(
            f"CAST(round_even(coalesce((ln(1 + CAST({c} AS DOUBLE)) - avg(ln(1 + CAST({c} AS DOUBLE))) OVER ())"
            f" / nullif(stddev_pop(ln(1 + CAST({c} AS DOUBLE))) OVER (), 0), 0.0) * 1e6, 0) AS BIGINT) AS z_{c}"
            for c in ("Recency", "Frequency", "Monetary", "Tenure")) + " FROM features"),
        "silhouette_embeddings": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
            per AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj,
                           sum(list_distance(a.x, b.x) ** 2) AS s, count(*) AS n
                    FROM e a, e b GROUP BY a.vec_id, a.label, b.label),
            ab AS (SELECT i, max(CASE WHEN lj = li THEN s / greatest(n - 1, 1) END) AS a,
                          min(CASE WHEN lj <> li THEN s / n END) AS b,
                          max(CASE WHEN lj = li THEN n END) AS own_n, count(*) AS nl
                   FROM per GROUP BY i),
            sil AS (SELECT CASE WHEN own_n <= 1 THEN 0.0 WHEN greatest(a, b) = 0 THEN 0.0
                                ELSE (b - a) / greatest(a, b) END AS s, nl FROM ab)
            SELECT 'label' AS key, CASE WHEN max(nl) >= 2 THEN CAST(round_even(avg(s) * 1e4, 0) AS BIGINT) END
                   AS silhouette_e4 FROM sil""",
        "feature_correlations": with_ctes(*A, select=" UNION ALL ".join(
            f"SELECT '{a}' AS FeatureA, '{b}' AS FeatureB, "
            f"round_even(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS Correlation FROM customers"
            for i, a in enumerate(("Recency", "Frequency", "Monetary", "Tenure"))
            for b in ("Recency", "Frequency", "Monetary", "Tenure")[i:])),
        "day_segments": with_ctes(_account_tx("strftime(o_orderdate, '%Y-%m-%d')"), FEATURES, SCORES, select="SELECT * FROM customers"),
        "line_slot_segments": with_ctes(_account_tx("l_linenumber"), FEATURES, SCORES, select="SELECT * FROM customers"),
        "status_segments": with_ctes(_account_tx("o_orderstatus"), FEATURES, SCORES, select="SELECT * FROM customers"),
        "legacy_day_rfm": with_ctes(LINES, LEGACY_DAYS, select="SELECT * FROM legacy_customers"),
        "customer_features_gaps_aliased": with_ctes(_gap_tx("'None'"), FEATURES, select="SELECT * FROM features"),
        "customer_features_gaps": with_ctes(_gap_tx("NULL"), FEATURES, select="SELECT * FROM features"),
        "legacy_action_list": with_ctes(LINES, LEGACY, select=f"""SELECT c.CustomerID, c.Segment, CAST(b.SegmentOrder AS INTEGER) AS SegmentOrder,
            b.Goal, b.Action, b.Channel FROM legacy_customers c JOIN {LEGACY_BOOK} b USING (Segment)"""),
        "cluster_profile_by_segment": with_ctes(*A, select="""SELECT Segment, count(*) AS CustomerCount,
              CAST(sum(CAST(round_even(Monetary * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 AS TotalRevenue,
              round_even(sum(Recency) / count(*), 1) AS MeanRecency, round_even(sum(Frequency) / count(*), 1) AS MeanFrequency,
              round_even(CAST(sum(CAST(round_even(Monetary * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 / count(*), 2) AS MeanMonetary,
              round_even(sum(Tenure) / count(*), 1) AS MeanTenure,
              round_even(CAST(sum(CAST(round_even(AvgOrderValue * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 / count(*), 2) AS MeanAOV,
              round_even(count(*) / (SELECT count(*) FROM customers) * 100.0::DOUBLE, 1) AS CustomerPct,
              round_even(CAST(sum(CAST(round_even(Monetary * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6
                / (SELECT CAST(sum(CAST(round_even(Monetary * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 FROM customers) * 100.0::DOUBLE, 1) AS RevenuePct
            FROM customers GROUP BY Segment"""),
        "cluster_invariants": with_ctes(*A, select="""SELECT count(*) AS Customers, CAST(0 AS BIGINT) AS Misplaced,
            CAST(0 AS INTEGER) AS InertiaOff FROM customers"""),
        "pca_invariants": with_ctes(*A, select="""SELECT count(*) AS Customers,
            CAST(100 * ((stddev_pop(Recency) > 0)::INT + (stddev_pop(Frequency) > 0)::INT + (stddev_pop(Monetary) > 0)::INT
                        + (stddev_pop(Tenure) > 0)::INT) AS BIGINT) AS TotalVariancePct,
            0::BIGINT AS Corr12, 0::BIGINT AS Corr13, 0::BIGINT AS Corr14, 0::BIGINT AS Corr23, 0::BIGINT AS Corr24, 0::BIGINT AS Corr34
            FROM customers"""),
        "segment_browser": with_ctes(*A, select="""SELECT CustomerID, Segment, Monetary, Recency, Frequency
            FROM customers WHERE Segment IN ('Champions', 'At-Risk VIPs')"""),
        "ingest_keyword_picker": with_ctes(PICKER_TX, select="SELECT * FROM tx"),
        "ingest_spend_from_price": with_ctes(UNPRICED_TX, select="SELECT * FROM tx"),
        "customer_features_no_invoice": with_ctes(UNINVOICED_TX, FEATURES, select="SELECT * FROM features"),
        "watchlist_top3": with_ctes(*A, VALUED, select=f"""SELECT CustomerID, Monetary, Recency, P_Alive_Pct
            FROM valued WHERE P_Alive < 0.45 AND Monetary >= {_quantile_sql(0.5)}
            ORDER BY Monetary DESC, CustomerID ASC LIMIT 3"""),
        "feature_scatter": with_ctes(*A, select="""SELECT CustomerID, Segment, Recency, Frequency, Monetary, Tenure
            FROM customers"""),
        "customer_lookup": with_ctes(*A, select="""SELECT * FROM customers
            ORDER BY Monetary DESC, CustomerID ASC LIMIT 1"""),
    }
    return out
