"""Tests of changed files that lie nowhere near them."""

from corpusmill.operators import rank


def test_each_pair_once_and_dealt_by_stem_name_and_part(spark):
    changed = ["src/auth/login/Form.ts", "src/x.ts", "lib/auth/y", "form.py", "auth/Form.go"]
    files = ["tests/auth_login_form.py", "tests/login/form.py", "tests/other/form.py", "t/ux.test.ts", "tests/auth/y", "auth/Form.test.go", "auth/form.py"]
    table = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    found = rank.tests_of(table(changed), table(files + files[:2]))
    assert sorted(map(tuple, found.select("path", "test_path").collect())) == sorted([
        ("auth/Form.go", "auth/Form.test.go"),
        ("src/auth/login/Form.ts", "tests/auth_login_form.py"), ("src/auth/login/Form.ts", "tests/login/form.py"), ("src/auth/login/Form.ts", "auth/Form.test.go"),
        ("form.py", "tests/auth_login_form.py"), ("form.py", "tests/login/form.py"), ("form.py", "tests/other/form.py"), ("form.py", "auth/Form.test.go"),
        ("src/x.ts", "t/ux.test.ts"), ("lib/auth/y", "tests/auth/y"), ("lib/auth/y", "tests/auth_login_form.py"),
    ])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" in plan and "gram#" not in plan
