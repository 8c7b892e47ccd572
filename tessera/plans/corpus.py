"""The query corpus: sixty queries over the TPC-H-like tables.

Each text is in the form plans/sqltext.py reads; it is compiled from its plan, never passed to
Spark as SQL.  The same text is the oracle.
"""

# The corpus.
CORPUS = {
    "q1": "SELECT n_nationkey,n_name,n_regionkey FROM nation",
    "q2": "SELECT r_regionkey,r_name FROM region",
    "q3": "SELECT p_partkey,p_name,p_brand,p_type FROM part",
    "q4": "SELECT s_suppkey,s_name,s_acctbal FROM supplier",
    "q5": "SELECT c_custkey,c_name,c_mktsegment FROM customer",
    "q6": "SELECT n_name FROM nation WHERE n_regionkey=1",
    "q7": "SELECT r_name FROM region WHERE r_name<>'AFRICA'",
    "q8": "SELECT p_name,p_size FROM part WHERE p_size>25",
    "q9": "SELECT p_partkey,p_retailprice FROM part WHERE p_retailprice>=950.0",
    "q10": "SELECT s_name,s_acctbal FROM supplier WHERE s_acctbal<0.0",
    "q11": "SELECT c_name,c_mktsegment FROM customer WHERE c_mktsegment='AUTOMOBILE'",
    "q12": "SELECT o_orderkey,o_totalprice FROM orders WHERE o_orderstatus='O'",
    "q13": "SELECT l_orderkey,l_linenumber FROM lineitem WHERE l_quantity<=10",
    "q14": "SELECT l_partkey,l_suppkey FROM lineitem WHERE l_quantity>25",
    "q15": "SELECT l_orderkey,l_discount FROM lineitem WHERE l_discount>=0.05 AND l_discount<=0.07",
    "q16": "SELECT n_name FROM nation ORDER BY n_name,n_nationkey",
    "q17": "SELECT r_name FROM region ORDER BY r_name DESC,r_regionkey",
    "q18": "SELECT p_brand,p_size FROM part ORDER BY p_brand,p_size DESC,p_partkey",
    "q19": "SELECT s_acctbal,s_name FROM supplier ORDER BY s_acctbal DESC,s_suppkey",
    "q20": "SELECT c_mktsegment,c_acctbal FROM customer ORDER BY c_mktsegment,c_acctbal DESC,c_custkey",
    "q21": "SELECT n_name FROM nation WHERE n_regionkey=3 ORDER BY n_name DESC,n_nationkey",
    "q22": "SELECT p_name FROM part WHERE p_size<10 ORDER BY p_name,p_partkey",
    "q23": "SELECT s_name,s_acctbal FROM supplier WHERE s_acctbal>5000.0 ORDER BY s_acctbal DESC,s_suppkey",
    "q24": "SELECT c_name FROM customer WHERE c_mktsegment='HOUSEHOLD' ORDER BY c_name,c_custkey",
    "q25": "SELECT o_orderkey,o_totalprice FROM orders WHERE o_orderstatus='F' ORDER BY o_totalprice DESC,o_orderkey",
    "q26": "SELECT l_orderkey,l_quantity FROM lineitem WHERE l_shipdate>'1998-01-01' ORDER BY l_quantity DESC,l_orderkey,l_linenumber",
    "q27": "SELECT l_suppkey FROM lineitem WHERE l_quantity<2 ORDER BY l_suppkey,l_partkey",
    "q28": "SELECT l_extendedprice FROM lineitem WHERE l_returnflag='R' AND l_linestatus='F' ORDER BY l_extendedprice DESC,l_orderkey,l_linenumber",
    "q29": "SELECT c_name FROM customer WHERE c_acctbal<0.0 ORDER BY c_name,c_custkey",
    "q30": "SELECT p_brand FROM part WHERE p_type='PROMO' ORDER BY p_brand,p_partkey",
    "q31": "SELECT n_name,r_name FROM nation,region",
    "q32": "SELECT s_name,r_name FROM supplier,region",
    "q33": "SELECT c_name,n_name FROM (SELECT c_name,c_custkey FROM customer WHERE c_custkey=1) c,nation",
    "q34": "SELECT p_name,l_quantity FROM (SELECT p_name,p_partkey FROM part WHERE p_partkey=10) p,(SELECT l_quantity FROM lineitem WHERE l_suppkey=5) l",
    "q35": "SELECT o_orderkey,l_linenumber FROM (SELECT o_orderkey FROM orders WHERE o_orderkey=5) o,(SELECT l_linenumber FROM lineitem WHERE l_orderkey=5) l",
    "q36": "SELECT n_name,r_name FROM nation,region WHERE n_regionkey=r_regionkey",
    "q37": "SELECT c_name,n_name FROM customer,nation WHERE c_nationkey=n_nationkey",
    "q38": "SELECT s_name,n_name FROM supplier,nation WHERE s_nationkey=n_nationkey",
    "q39": "SELECT p_name,l_quantity FROM part,lineitem WHERE p_partkey=l_partkey",
    "q40": "SELECT s_name,l_quantity FROM supplier,lineitem WHERE s_suppkey=l_suppkey",
    "q41": "SELECT c_name,o_totalprice FROM customer,orders WHERE c_custkey=o_custkey AND c_mktsegment='MACHINERY' ORDER BY o_totalprice DESC,c_custkey,o_orderkey",
    "q42": "SELECT o_orderdate,l_quantity FROM orders,lineitem WHERE o_orderkey=l_orderkey AND o_orderstatus='P' ORDER BY o_orderdate,l_orderkey,l_linenumber",
    "q43": "SELECT n_name,r_name FROM nation,region WHERE n_regionkey=r_regionkey AND r_name='EUROPE' ORDER BY n_name,n_nationkey",
    "q44": "SELECT s_name,n_name FROM supplier,nation WHERE s_nationkey=n_nationkey AND s_acctbal>1000.0 ORDER BY s_acctbal DESC,s_suppkey",
    "q45": "SELECT p_name,l_extendedprice FROM part,lineitem WHERE p_partkey=l_partkey AND p_size=50 ORDER BY l_extendedprice DESC,p_partkey,l_suppkey",
    "q46": "SELECT c_name,n_name FROM customer,nation,region WHERE c_nationkey=n_nationkey AND n_regionkey=r_regionkey AND r_name='ASIA' ORDER BY c_name,c_custkey",
    "q47": "SELECT p_brand,s_name FROM part,supplier,lineitem WHERE p_partkey=l_partkey AND s_suppkey=l_suppkey AND p_size<5 ORDER BY p_brand,s_name,p_partkey,s_suppkey",
    "q48": "SELECT o_orderkey,c_mktsegment FROM orders,customer WHERE o_custkey=c_custkey AND o_totalprice>50000.0 ORDER BY o_totalprice DESC,o_orderkey",
    "q49": "SELECT l_linenumber,p_name FROM lineitem,part WHERE l_partkey=p_partkey AND l_quantity>45 ORDER BY p_name,l_orderkey,l_linenumber",
    "q50": "SELECT s_name,p_name FROM supplier,part,lineitem WHERE s_suppkey=l_suppkey AND p_partkey=l_partkey AND l_quantity=1 ORDER BY s_name,p_name,s_suppkey,p_partkey",
    "b1": "SELECT l_returnflag,l_linestatus,l_quantity,l_extendedprice,l_discount,l_tax FROM lineitem WHERE l_shipdate<='1998-11-30' ORDER BY l_returnflag,l_linestatus,l_orderkey,l_linenumber",
    "b2": "SELECT s_acctbal,s_name,n_name,p_partkey,p_brand,l_extendedprice FROM part,supplier,lineitem,nation,region WHERE p_partkey=l_partkey AND s_suppkey=l_suppkey AND p_size=15 AND s_nationkey=n_nationkey AND n_regionkey=r_regionkey AND r_name='EUROPE' ORDER BY s_acctbal DESC,n_name,s_name,p_partkey,l_suppkey",
    "b3": "SELECT l_orderkey,o_orderdate,o_orderpriority FROM customer,orders,lineitem WHERE c_mktsegment='BUILDING' AND c_custkey=o_custkey AND l_orderkey=o_orderkey AND o_orderdate<'1998-03-15' AND l_shipdate>'1998-03-15' ORDER BY o_orderdate,l_orderkey,l_linenumber",
    "b4": "SELECT n_name,l_extendedprice,l_discount FROM customer,orders,lineitem,supplier,nation,region WHERE c_custkey=o_custkey AND l_orderkey=o_orderkey AND l_suppkey=s_suppkey AND c_nationkey=s_nationkey AND s_nationkey=n_nationkey AND n_regionkey=r_regionkey AND r_name='ASIA' AND o_orderdate>='1996-01-01' AND o_orderdate<'1997-01-01' ORDER BY l_extendedprice DESC,l_discount DESC,l_orderkey,l_linenumber",
    "b5": "SELECT l_extendedprice,l_discount FROM lineitem WHERE l_shipdate>='1996-01-01' AND l_shipdate<'1997-01-01' AND l_discount>0.05 AND l_discount<0.07 AND l_quantity<24 ORDER BY l_orderkey,l_linenumber",
    "b6": "SELECT c_custkey,c_name,l_extendedprice,l_discount,c_acctbal,n_name FROM customer,orders,lineitem,nation WHERE c_custkey=o_custkey AND l_orderkey=o_orderkey AND o_orderdate>='1996-10-01' AND o_orderdate<'1997-10-01' AND l_returnflag='R' AND c_nationkey=n_nationkey ORDER BY l_extendedprice DESC,l_discount DESC,l_orderkey,l_linenumber",
    "b7": "SELECT l_partkey,l_extendedprice,l_quantity FROM lineitem,supplier,nation WHERE l_suppkey=s_suppkey AND s_nationkey=n_nationkey AND n_name='NATION_7' ORDER BY l_quantity DESC,l_partkey,l_suppkey",
    "b8": "SELECT s_name,s_suppkey,ps_partkey,ps_quantity,l_quantity FROM supplier,nation,(SELECT l_partkey ps_partkey,l_suppkey ps_suppkey,l_quantity ps_quantity FROM lineitem) ps,part,lineitem WHERE s_nationkey=n_nationkey AND n_name='NATION_3' AND s_suppkey=ps_suppkey AND ps_partkey=p_partkey AND l_partkey=ps_partkey AND l_suppkey=ps_suppkey ORDER BY s_name,l_orderkey,l_linenumber",
    "b9": "SELECT s_name,l1.l_orderkey AS l1_l_orderkey,l1.l_suppkey AS l1_l_suppkey FROM supplier,lineitem l1,lineitem l2,orders,nation WHERE s_suppkey=l1.l_suppkey AND o_orderkey=l1.l_orderkey AND o_orderstatus='F' AND l1.l_discount>l1.l_tax AND l2.l_orderkey=l1.l_orderkey AND l2.l_suppkey<>l1.l_suppkey AND s_nationkey=n_nationkey AND n_name='NATION_20' ORDER BY s_name,l1.l_orderkey,l1.l_linenumber,l2.l_orderkey,l2.l_linenumber",
    "b10": "SELECT c_custkey,c_name,o_orderkey,o_orderdate,l_linenumber,l_partkey,l_suppkey,p_name,s_name,cn.n_name AS cn_n_name,sn.n_name AS sn_n_name FROM customer,orders,lineitem,part,supplier,nation cn,nation sn,region cr,region sr WHERE c_custkey=o_custkey AND o_orderkey=l_orderkey AND l_partkey=p_partkey AND l_suppkey=s_suppkey AND c_nationkey=cn.n_nationkey AND s_nationkey=sn.n_nationkey AND cn.n_regionkey=cr.r_regionkey AND sn.n_regionkey=sr.r_regionkey AND c_mktsegment='BUILDING' AND l_returnflag='R' AND p_size>=1 AND p_size<=25 AND cr.r_name='ASIA' AND sr.r_name='EUROPE' ORDER BY c_custkey,o_orderdate,o_orderkey,l_linenumber",
}
