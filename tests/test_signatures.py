"""Signatures and tables of parameters, by hand."""

import pytest
from pyspark.sql import functions as F

from docaudit.operators import signatures

LINES = {
    "function send(to: string, opts: Map<string, [a, b]> = {x: 1, y: 2}, ...rest): void {": ("send", ["to", "opts", "rest"]),
    "  async def fetch(self, url, *args, timeout=f(1, 2), **kw) -> Result:": ("fetch", ["url", "args", "timeout", "kw"]),
    "func (s *Server) Serve(addr string, n int) error {": ("Serve", ["addr", "n"]),
    "pub(crate) fn x()": None,
    "fn grow<T>(&mut self, by: T)": ("grow", ["by"]),
    "export const add = async (a: number, cb: (x: number) => void): Promise<void> => {": ("add", ["a", "cb"]),
    "log(message: string, level?: Level): void": ("log", ["message", "level"]),
    "call(a, b)": None,
    "function open({a, b}, c) {": None,
    "function none() {": ("none", []),
    "function broken(a, b": None,
    "x = 1": None,
}


@pytest.mark.parametrize("line", LINES)
def test_signatures(spark, line):
    (found,) = spark.createDataFrame([(line,)], "t string").select(signatures.signature(F.col("t")).alias("s")).collect()
    assert (found.s and (found.s.fn, list(found.s.names))) == LINES[line]


TEXT = """```ts
function send(to: string, cc: string): void
```
Words.

| Parameter | Type |
|---|---|
| `to` | string |
| **bcc** | string |

| Parameter | Type |
|---|---|
| other | x |

```py
def a(x): pass
def b(y): pass
```
| Parameter |
|---|
| z |

```py
def c(x): pass
```
## Next
| Argument |
|---|
| q |

```py
def d(x, y): pass
```
| Option |
|---|
| q |

~~~
fn e(v: u8)
~~~
| arg |
| --- |
"""


def test_tables_under_signatures(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (1, TEXT)], "doc_id int, text string")
    found = sorted(tuple(r) for r in signatures.parameter_mismatches(docs).collect())
    own = [(1, 6, "send", "bcc", "table"), (1, 6, "send", "cc", "signature"), (1, TEXT.split("\n").index("| arg |") + 1, "e", "v", "signature")]
    assert found[::2] == own and found[1::2] == own
