"""Small literal tables as DataFrames and as SQL, and a made-up source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def literal(value) -> str:
    """A value as SQL that DuckDB reads."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


class Table:
    """Rows that queries and their SQL share."""

    def __init__(self, name: str, ddl: str, rows: list[tuple]):
        self.name, self.ddl, self.rows = name, ddl, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    @property
    def sql(self) -> str:
        """A common table expression."""
        kinds = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}
        columns = [c.split() for c in self.ddl.split(", ")]
        casts = ", ".join(f"{c}::{kinds[k]} AS {c}" for c, k in columns)
        rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {rows}) t({', '.join(c for c, _ in columns)}))"


def _body(n: int, word: str = "step") -> str:
    return "\n".join(f"  {word}({i});" for i in range(n))


FILES = Table("files", "path string, content string", [
    ("/src/index.js", "import { start, stop as halt } from './core/engine';\nimport App from './components/App';\nimport express from 'express';\nimport 'reflect-metadata';\nconst lazy = import('./lazy');\nexport default App;\nexport { start, halt };\n"),
    ("/src/lazy.js", "import * as util from '../src/utils/strings.js';\nexport const answer = 42;\nlet count: number = 0;\nvar label: string;\n"),
    ("/src/core/engine.ts", "import { join } from 'path';\nimport { query } from '../services/db.service';\nimport App from '../components/App';\nexport async function start(name: string, retries = 3) {\n" + _body(24) + "\n}\nexport function stop() {\n  return 1;\n}\nexport class Engine extends Base {\n  run() { return 1; }\n}\n"),
    ("/src/components/App.jsx", "import React, { useState } from 'react';\nimport { start } from '../core/engine';\nimport Button from './Button';\nexport const App = (props, id, list, onClick) => {\n  const [open, setOpen] = useState(false);\n  setOpen(true);\n  fetch('/api/users');\n  return <Button label={open} onClick={start} />;\n};\n" + "export default App;\n"),
    ("/src/components/Button.tsx", "import { useContext, createContext } from 'react';\nimport { pad } from '../utils/strings';\nimport deep from '../../shared/v1.2/deep';\nexport const Theme = createContext(null);\nexport const Button = async ({ label, size }) => {\n" + _body(60, "draw") + "\n}\n"),
    ("/src/utils/strings.js", "export function pad(text, n) {\n  return text;\n}\nconst compareMatrixGrid = function(a, b, c, d, e, f) {\n" + _body(33, "loop") + "\n}\nexport const getUserById = async (id) => {\n" + _body(18, "await") + "\n}\n"),
    ("/src/services/db.service.ts", "import mongoose from 'mongoose';\nimport lodash from 'lodash';\nimport { Engine } from '../core/engine';\nmongoose.connect('mongodb://localhost:27017/app');\nconst password = 'hunter2secret';\nexport async function query(list, key) {\n" + _body(120, "read") + "\n}\nexport function syncReadFile(item) {\n" + _body(8, "x") + "\n}\nexport async function processAll(list) {\n" + _body(220, "y") + "\n}\n"),
    ("/src/services/pay.service.js", "const stripe = require('stripe');\nconst url = process.env.API_TOKEN;\naxios.post('https://api.example.com/pay', body);\nconst socket = new WebSocket('ws://live.example.com');\nconst auth = jwt.sign(user);\n"),
    ("/src/models/user.model.ts", "export interface User { name: string }\nexport class User {\n  constructor() { this.items = [1, (2)]; }\n}\n"),
    ("/shared/v1.2/deep.js", "export const deep = (x) => { return x; };\n"),
    ("/src/broken.js", "function open( {\n  if (x) {\n    y(];\n"),
    ("/src/closed.js", "}\nfunction ok() { return 1; }\n"),
    ("/src/alone.js", "\n"),
])

PATHS = Table("paths", "path string, size long", [(p, len(c)) for p, c in FILES.rows] + [("/node_modules/x/index.js", 10), ("/dist/app.js", 5), ("/src/vendor.min.js", 7), ("/src/readme.md", 3), ("/src/huge.ts", 20_000_000), ("/a/.git/hook.js", 1), ("/src/page.tsx", 10 << 20)])

MANIFESTS = Table("manifests", "path string, content string", [
    ("/package.json", '{"name": "root", "version": "1.0.0", "workspaces": ["packages/*"], "dependencies": {"lodash": "^4.17.0", "express": "4.18.2"}, "devDependencies": {"jest": "28.1.3", "lodash": "4.17.20"}, "optionalDependencies": {"fsevents": "2.3.2"}}'),
    ("/packages/ui/package.json", '{"name": "@acme/ui", "version": "0.1.0", "dependencies": {"react": "^18.2.0", "@acme/core": "*"}, "peerDependencies": {"react": ">=17"}}'),
    ("/packages/core/package.json", '{"name": "@acme/core", "version": "0.2.0", "dependencies": {"moment": "2.29.4"}}'),
    ("/other/package.json", '{"name": "lost", "version": "9.9.9", "dependencies": {"d3": "7.0.0"}}'),
    ("/bad/package.json", "{broken"),
])

LOCK_V1 = '{"lockfileVersion": 1, "dependencies": {"orbit": {"version": "2.0.0-rc.1", "requires": {"gyro": "1.x", "ghost": "*"}}, "gyro": {"version": "1.9.0", "resolved": "https://pkgs.test/gyro.tgz", "requires": {"vane": ">=0.2 <1"}}, "vane": {"version": "0.4.4", "requires": {"bolt": "~3.1"}}, "bolt": {"version": "3.1.7+build.5", "requires": {"gyro": "1.9.0"}}, "sail": {"version": "6.0.0", "integrity": "sha1-s", "requires": {"bolt": "*"}}, "lamp": {"version": "0.0.1", "dev": true}, "tide": {"version": "7.7.7", "optional": true, "bundled": true}}}'
LOCK_V2 = '{"lockfileVersion": 3, "packages": {"": {"name": "harbour"}, "node_modules/orbit": {"version": "2.0.0", "resolved": "https://pkgs.test/orbit.tgz", "integrity": "sha1-o", "dependencies": {"gyro": "1.x"}}, "node_modules/orbit/node_modules/gyro": {"version": "0.9.1"}, "node_modules/@dock/crane": {"version": "4.4.0", "devOptional": true, "dependencies": {"orbit": "^2.0.0"}}, "node_modules/@dock/crane/node_modules/@dock/rope": {"version": "1.0.0"}, "node_modules/quay": {"version": "9.0.0", "peer": true, "dev": true}}}'
YARN = '# yarn lockfile v1\n\n\n"@dock/crane@^4.0.0", "@dock/crane@4.x", "@dock/crane@4.4.0":\n  version "4.4.0"\n  resolved "https://pkgs.test/crane.tgz"\n  dependencies:\n    orbit "^2.0.0"\n    "@dock/rope" "1.0.0"\n\nquay@*:\n  version "9.0.0"\n\norbit@^2.0.0:\n  version "2.0.0"\n  resolved "https://pkgs.test/orbit.tgz"\n  integrity sha1-o\n  dependencies:\n    gyro "1.x"\n'

ADVISORIES = Table("advisories", "id string, package string, affected string, cvss double", [("A-1", "lodash", "<4.17.21", 7.2), ("A-2", "lodash", "4.17.20", 9.8), ("A-3", "express", "^4.0.0", 5.3), ("A-4", "jest", "28.*", 3.1), ("A-5", "moment", ">=2.0.0", 9.1), ("A-6", "react", "<16.0.0", 6.0)])
INSTALLED = Table("installed", "package string, version string, license string, latest string, size_kb long, shakable boolean, side_effects boolean, deprecated boolean", [
    ("lodash", "4.17.20", "MIT", "4.17.21", 70, False, True, False), ("express", "4.18.2", "MIT", "5.0.1", 210, False, False, False), ("jest", "28.1.3", "GPL-3.0", "29.7.0", 1500, False, True, True), ("moment", "2.29.4", "proprietary", "2.30.1", 290, False, True, True), ("react", "18.2.0", "Apache-2.0", "18.2.0", 45, True, False, False),
    ("fsevents", "2.3.2", "LGPL-3.0", "2.3.3", 12, True, False, False), ("date-fns", "2.29.0", "MPL-2.0", "3.0.0-beta.1", 80, True, False, False), ("oddlib", "1.0.0", "UNKNOWN", "1.0.0", 3, False, False, False), ("cc-data", "0.1.0", "CC0-1.0", "0.2.0", 1, False, False, False),
])
