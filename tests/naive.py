"""A plain evaluator of one query over a few documents, one segment after the other, written from the description of the semantics
without the library's compiler: postings are loaded first, then each candidate is matched and scored."""

import math
import re

from vellum.plans.ast import Bool, Phrase, Term, Wildcard


def pattern(p):
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + r"\Z", re.I)


class Segment:
    def __init__(self, docs, config):
        """docs: [(ord, id, {field: text})]"""
        self.config, self.docs = config, docs
        self.index, self.length = {}, {}
        for o, _, fields in docs:
            for f, text in fields.items():
                if text is None or f in config.no_index:
                    continue
                toks = config.analyzer(f).words(text)
                if toks:
                    self.length[o, f] = len(toks)
                for t, p in toks:
                    self.index.setdefault((f, t), {}).setdefault(o, []).append(p)
        self.fields = {f for _, f in self.length}
        self.average = {f: sum(n for (_, g), n in self.length.items() if g == f) / sum(g == f for _, g in self.length) for f in self.fields}

    def phrase(self, terms, f):
        out, at = [], 0
        for raw in terms:
            toks = self.config.analyzer(f).words(raw)
            out += [(t, at + p) for t, p in toks]
            at += toks[-1][1] if toks else 1
        return out

    def terms(self, n):
        if isinstance(n, Bool):
            for c in (*n.must, *n.should):
                yield from self.terms(c)
        elif isinstance(n, Term):
            for f in [n.field] if n.field else sorted(self.fields):
                toks = self.config.analyzer(f).words(n.term)
                yield from [(f, t) for t, _ in toks] or [(f, n.term)]
        elif isinstance(n, Phrase):
            for f in [n.field] if n.field else sorted(self.fields):
                yield from [(f, t) for t, _ in self.phrase(n.terms, f)]

    def wild(self, n):
        if isinstance(n, Bool):
            for c in (*n.must, *n.should, *n.must_not):
                yield from self.wild(c)
        elif isinstance(n, Wildcard):
            yield from [k for k in self.index if (not n.field or k[0] == n.field) and pattern(n.pattern).match(k[1])]

    def search(self, root, deleted):
        loaded = {k: self.index[k] for k in [*self.terms(root), *self.wild(root)] if k in self.index}
        out = set()
        if isinstance(root, Bool):
            for c in root.must_not:
                for k in self.terms(c):
                    out |= set(self.index.get(k, ()))
        for o in {o for p in loaded.values() for o in p}:
            i = next(i for n, i, _ in self.docs if n == o)
            if o in out or i in deleted:
                continue
            if isinstance(root, (Bool, Phrase)) and not self.match(root, o, loaded):
                continue
            s = self.score(root, o, loaded)
            if s > 0:
                yield o, i, s

    def match(self, n, o, loaded):
        if isinstance(n, Bool):
            if n.must:
                return all(self.match(c, o, loaded) for c in n.must)
            return any(self.match(c, o, loaded) for c in n.should) if n.should else True
        if isinstance(n, Term):
            return any(o in p for (f, t), p in loaded.items() if t == n.term and (not n.field or f == n.field))
        if isinstance(n, Wildcard):
            return any(o in p for (f, t), p in loaded.items() if pattern(n.pattern).match(t) and (not n.field or f == n.field))
        if not n.terms:
            return True
        return any(self.places(n, f, o, loaded) for f in ([n.field] if n.field else {f for f, _ in loaded}))

    def places(self, n, f, o, loaded):
        words = self.phrase(n.terms, f)
        if not words:
            return True
        have = [loaded.get((f, t), {}).get(o) for t, _ in words]
        if not all(have):
            return False
        return any(all(any(abs(p - (s + off - words[0][1])) <= (n.slop or 0) for p in ps) for ps, (_, off) in zip(have[1:], words[1:])) for s in have[0])

    def score(self, n, o, loaded):
        boost = 1.0 if n.boost is None else n.boost

        def one(k, b):
            p = loaded.get(k)
            if not p or o not in p:
                return 0.0
            tf, df, total = len(p[o]), len(p), len(self.docs)
            idf = max(0.0, math.log((total - df + 0.5) / (df + 0.5) + 1))
            norm = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * self.length[o, k[0]] / self.average[k[0]]))
            return idf * norm * self.config.boost.get(k[0], 1.0) * b

        if isinstance(n, Bool):
            return sum(self.score(c, o, loaded) for c in (*n.must, *n.should))
        if isinstance(n, Term):
            return sum(one(k, boost) for k in loaded if k[1] == n.term and (not n.field or k[0] == n.field))
        if isinstance(n, Phrase):
            return sum(one(k, boost / len(n.terms)) for t in n.terms for k in loaded if k[1] == t and (not n.field or k[0] == n.field))
        return sum(one(k, boost) for k in loaded if pattern(n.pattern).match(k[1]) and (not n.field or k[0] == n.field))
