from conftest import rows

from strataquery.functions import parsers as P

SQL = """-- CREATE TABLE [x].[commented] (a int)
CREATE TABLE [dbo].[Or]]ders] (
    [Id] BIGINT NOT NULL,
    Total DECIMAL(10, 2),
    CONSTRAINT PK PRIMARY KEY ([Id])
);
GO
CREATE OR ALTER PROC dbo.Load @a INT AS
BEGIN
    EXEC dbo.Save 'FROM fake.one'; /* JOIN no.two */
    SELECT * FROM [dbo].[Orders] o JOIN #tmp t ON 1 = 1;
    UPDATE dbo.Orders SET x = 1; DELETE FROM sys.objects;
END
go
CREATE VIEW v AS SELECT 1
"""


def test_sql_symbols():
    assert P.sql_symbols(SQL) == [("table", "Or]ders", "dbo", 2, 6), ("column", "Id", "Or]ders", 3, 3), ("column", "Total", "Or]ders", 4, 4), ("storedProcedure", "Load", "dbo", 8, 13), ("view", "v", None, 15, 15)]
    assert P.sql_symbols("") == P.sql_symbols("-- only\n") == P.sql_symbols("CREATE TABLE [dbo].[Cut") == P.sql_symbols("CREATE TABLE dbo.") == []


def test_sql_calls():
    assert P.sql_calls(SQL) == [("sqlExecute", "dbo", "Save", 10), ("sqlRelation", "dbo", "Orders", 11)]


def test_xml():
    got = P.xml_elements('<?xml version="1.0"?>\n<a x="1>2">\n <b>one</b><!-- <no/> -->\n <c/><d><![CDATA[<e>]]></d>\n</a></z>')
    assert [(r[1], r[3], r[4], r[5], r[7], r[8]) for r in got] == [(None, "a", 2, 5, "", False), (0, "a > b", 3, 3, "one", True), (0, "a > c", 4, 4, "", True), (0, "a > d", 4, 4, "<e>", True)]
    assert got[0][6] == ["x=1>2"]
    assert P.xml_elements("<a>" + "y" * 300)[0][7] == "y" * 197 + "..."


def test_custom_elements():
    html = '<!-- <a-b> --><App-X y="<q-r>"><ng-if></ng-if><style><z-z></style></app-x><script>"<k-k>"</script><l-m><![CDATA[<c-c>]]><app-x/><script src="a"/><o-o>'
    assert P.custom_elements(html) == ["app-x", "l-m", "o-o"]
    assert P.custom_elements("") == P.custom_elements("<a-") == []


CS = """namespace N {
    public interface IStore : IBase<int, string>, IOther { }
    public sealed class Store<T> : IStore
    {
        private readonly IClock _clock; // class Fake { }
        public string Name { get; set; }
        public Store(IClock clock) { _clock = clock; }
        public async Task<int> Load(string key, int n = 1)
        {
            if (key == null || n > 1 && n < 9) { throw new Exception("if (x) { return; }"); }
            else if (n == 2) { foreach (var x in key) { _clock.Tick(x); } }
            else { return 1; }
            return Find(key);
        }
    }
}
"""


def test_csharp():
    got = {(s[0], s[1]): s for s in P.code_symbols(CS, "cs")}
    assert got["interface", "IStore"][6] == ["IBase<int, string>", "IOther"]
    assert got["class", "Store"][3:5] == (3, 15) and got["field", "_clock"][2] == "Store" and ("property", "Name") in got and ("constructor", "Store") in got
    load = got["method", "Load"]
    assert load[2:5] == ("Store", 8, 14) and load[7] == 2
    assert load[8:] == (6, 7, 2, 3, 0)  # if, ||, &&, else if, foreach; 1 + 1 + 1 + 1 + 2 + else 1
    assert ("class", "Fake") not in got
    assert [c[3:6] for c in P.code_calls(CS, "cs") if c[0] == "Load"] == [("Exception", None, None), ("Tick", "_clock", "IClock"), ("Find", None, None)]


def test_typescript():
    got = {(s[0], s[1]): s for s in P.code_symbols("export class A extends B implements C {\n  run(x: number): void {\n    if (x) { this.go(() => 1); }\n  }\n}\nexport function f(a, b) { return a ? b : 1; }\ntype T = string;\nconst z = `class Q {}`;\n", "ts")}
    assert got["class", "A"][6] == ["B", "C"] and got["method", "run"][2] == "A" and got["method", "run"][8] == 2 and got["method", "run"][12] == 1
    assert got["function", "f"][7] == 2 and got["function", "f"][8] == 2 and ("typeAlias", "T") in got and ("variable", "z") in got and ("class", "Q") not in got


def test_rust():
    got = {(s[0], s[1]): s for s in P.code_symbols("pub struct S { a: u8 }\ntrait T { fn t(&self); }\nimpl T for S {\n  pub fn t(&self) -> Option<u8> {\n    for x in y { match x { 1 => 2, _ => 3 } }\n    go()?;\n    None\n  }\n}\nconst MAX: u8 = 1;\nfn free() {}\n", "rs")}
    assert ("struct", "S") in got and ("interface", "T") in got and got["method", "t"][2] in ("S", "T") and ("variable", "MAX") in got and got["function", "free"][2] is None


def test_plans_over_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, CS), (4, "x" * 100_000)], "file_id long, text string")
    assert {r.file_id for r in P.parsed(df, "code_symbols", "cs").collect()} == {3}
    assert rows(P.parsed(df.where("false"), "sql_symbols")) == []


def test_declared_types_and_extensions():
    code = "IStore a; Load(Foo b, int c) { var d = new Bar(1); var e = x as Baz; if (y is Qux z) { } var f = (Cast) g; }"
    got = P.declared_types(code, "cs")
    assert {k: got.get(k) for k in "abdezf"} == {"a": "IStore", "b": "Foo", "d": "Bar", "e": "Baz", "z": "Qux", "f": "Cast"}
    assert P.declared_types("f(a: Foo) { const b = new Bar(); }", "ts") == {"a": "Foo", "b": "Bar"}
    assert P.extension_methods("public static class X {\n public static int Len(this Str s) => 1;\n public static int No(Str s) => 1;\n}") == [("Len", "X", "Str", 2)]


def test_lines_of_calls_in_later_batches():
    text = "EXEC a.b;\n\nGO\n\n\nEXEC a.c;\r\nGO\r\nSELECT 1 FROM [Index];\n go 2 ;\n\nEXEC a.b"
    assert [(n, line) for _, _, n, line in P.sql_calls(text)] == [("b", 1), ("c", 6), ("Index", 8), ("b", 11)]
    assert [x[1] for x in P.sql_symbols("CREATE TABLE t ([Index] int, key (a), [Key] int, b int)") if x[0] == "column"] == ["Index", "Key", "b"]
