"""Statements of users: what may run on given tables, and what may not."""

import pytest

from weftgraph.engine import guarded

ALLOWED = (
    'select * from nodes',
    'select extract(year from cast(ts as date)) y from nodes',
    'with r as (select * from nodes) select count(*) c from r',
    'select n.id, (select max(id) from nodes) m from nodes n where exists (select 1 from nodes k where k.id=n.id)',
    'with recursive t(n) as (select 1 union all select n+1 from t where n<5) select * from t',
    'select name, row_number() over w as k from nodes window w as (order by id)',
    'select * from nodes lateral view explode(array(1,2)) e as x',
    'select * from values (1),(2) as v(x)',
    'select * from range(3)',
    'select id from nodes union select 3 order by id -- c',
    'select transform(array(1,2), x -> x+id) from nodes',
    "select * from nodes pivot (count(id) for name in ('a','b'))",
    "select upper(name) || '{x}', date_add(cast(ts as date),1), coalesce(id,0), case when id>1 then 1 else 2 end, cast(id as string), id in (1,2), name like 'a%' from nodes",
    '/* c */ with a as (select 1 x) select * from a;',
    'select a.* from (select * from nodes) a join nodes b using(id) group by all',
    'select delete, update from (select 1 as delete, 2 as update)',
    'select * from nodes where id in (select id from nodes where id > 1)',
)
REFUSED = (
    'select * from nodes, secret',
    'select * from `secret`',
    "select reflect('java.lang.System','getProperty','user.home')",
    "select java_method('java.lang.System','exit',1)",
    "select try_reflect('a','b')",
    'drop table nodes',
    'insert into nodes values (1)',
    'select 1; select 2',
    'select * from parquet.`/etc/passwd`',
    'select (select max(x) from secret)',
    'select * from nodes where id in (select x from secret)',
    'with r as (with secret as (select 1) select * from secret) select * from secret',
    'describe nodes',
    'show tables',
    'select myudf(1)',
    'select * from nodes lateral view explode(array((select max(x) from secret))) e as x',
    "select row_number() over w from nodes window w as (order by reflect('a','b'))",
    'explain select 1',
    'select * from csv.`/tmp/x`',
    'create view v as select 1',
    'set spark.x=1',
    'select input_file_name() from nodes',
    'from secret select *',
    'table secret',
    "select * from identifier('secret')",
    "select * from read_files('/tmp')",
    'select current_user()',
    "select * from (values (reflect('java.lang.System','getProperty','user.home'))) v(x)",
    'select sum(id) filter (where id > (select max(x) from secret)) from nodes',
    'cache table nodes',
    'with r as (select * from secret) select 1',
    'select * from nodes order by (select max(x) from secret)',
    'merge into nodes using secret on true when matched then delete',
    "EXECUTE IMMEDIATE 'select 1'",
    'select version()',
)


@pytest.fixture
def nodes(spark):
    spark.createDataFrame([(9,)], "x long").createOrReplaceTempView("secret")
    spark.udf.register("myudf", lambda x: x)
    yield spark.createDataFrame([(1, "a", "2020-05-06"), (2, "b", "2021-05-06")], "id long, name string, ts string")
    spark.catalog.dropTempView("secret")


@pytest.mark.parametrize("statement", ALLOWED)
def test_queries_on_given_tables_run(spark, nodes, statement):
    assert guarded(spark, statement, 3, {"nodes": nodes}).count() in (1, 2, 3)


@pytest.mark.parametrize("statement", REFUSED)
def test_what_else_there_is_does_not(spark, nodes, statement):
    with pytest.raises(ValueError):
        guarded(spark, statement, 50, {"nodes": nodes})


def test_without_given_tables_those_of_the_catalog_may_be_read(spark, nodes):
    assert guarded(spark, "select * from secret").collect() == [(9,)]
    for statement in ("select * from parquet.`/root/testdata/sf0.001/part.parquet`", "select * from nowhere"):
        with pytest.raises(ValueError):
            guarded(spark, statement)
