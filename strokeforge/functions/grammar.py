"""The grammar of token streams as a fold: validation, allowed sets and repair.

The state is (pending, state, path): arguments still to come; 0 boundary, 1 arguments, 2 after
a command or shape, 3 after a continuity token; and whether the last group is a path command.
"""

from __future__ import annotations

from . import ids
from .sqlgen import let, scan

# Coordinates that follow each id.
COMMAND_ARGS = {10: 1, 11: 1, 12: 1, 13: 1, 14: 3, 15: 2, 16: 2, 17: 0}
SHAPE_ARGS = {20: 2, 21: 3, 22: 3, 23: 5}
SPATIAL_ARGS = {60: 1, 61: 1, 62: 1, 63: 1, 64: 1, 65: 1, 66: 0, 67: 0, 68: 0, 69: 0, 70: 1}
ARGS = COMMAND_ARGS | SHAPE_ARGS | SPATIAL_ARGS


def arity(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN {k} THEN {n}" for k, n in ARGS.items()) + " END"


def _is(t: str, lo: int, hi: int) -> str:
    return f"({t} >= {lo} AND {t} < {hi})"


def boundary(t: str) -> str:
    return f"({_is(t, 10, 18)} OR {_is(t, 20, 24)} OR {_is(t, 60, 71)} OR {t} IN (2, 3))"


def allowed(t: str, s: str = "s") -> str:
    cont, curv = _is(t, 30, 34), _is(t, 40, 56)
    return f"CASE WHEN {s}.pending > 0 THEN {ids.is_coord(t)} WHEN {boundary(t)} THEN true WHEN {s}.state = 2 THEN {s}.path AND ({cont} OR {curv}) WHEN {s}.state = 3 THEN {curv} ELSE false END"


def advance(t: str, s: str = "s") -> dict[str, str]:
    """The fields of the state after t."""
    cmd, shp, spa, cont, curv = _is(t, 10, 18), _is(t, 20, 24), _is(t, 60, 71), _is(t, 30, 34), _is(t, 40, 56)
    n = arity(t)
    return {
        "pending": f"CASE WHEN {s}.pending > 0 THEN {s}.pending - 1 ELSE coalesce({n}, 0) END",
        "state": f"CASE WHEN {s}.pending > 0 THEN IF({s}.pending = 1, 2, 1) WHEN {n} > 0 THEN 1 WHEN {cmd} THEN 2 WHEN {cont} THEN 3 ELSE 0 END",
        "path": f"CASE WHEN {s}.pending > 0 THEN {s}.path WHEN {cmd} THEN true WHEN {shp} OR {spa} THEN false WHEN {cont} OR {curv} THEN {s}.path ELSE false END",
    }


def struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


NONE = "cast(array() AS ARRAY<INT>)"
START = {"pending": "0", "state": "0", "path": "false"}


def validated(tokens: str) -> str:
    """STRUCT<valid, position, reason>: the first violation, position -1 if there is none."""
    t, n = "t", f"size({tokens})"
    names = "CASE s.state WHEN 0 THEN 'boundary' WHEN 1 THEN 'args' WHEN 2 THEN 'post' ELSE 'curv' END"
    why = (
        f"CASE WHEN {t} = 1 THEN 'unexpected BOS' WHEN {t} = 2 AND s.pending > 0 THEN 'EOS while args pending' WHEN {t} = 2 AND s.i <> s.n - 1 THEN 'tokens after EOS' "
        f"WHEN {t} = 2 THEN '' WHEN NOT ({allowed(t)}) THEN concat('token ', {t}, ' not allowed in state (pending=', s.pending, ',state=', {names}, ')') END"
    )
    found = struct(advance(t) | {"i": "s.i + 1", "n": "s.n", "done": "w IS NOT NULL", "at": "IF(w = '', -1, s.i)", "why": "w"})
    step = f"IF(s.done, s, {let({'w': why}, found, 'struct<pending:int,state:int,path:boolean,i:int,n:int,done:boolean,at:int,why:string>')})"
    init = START | {"i": "1", "n": n, "done": "false", "at": "0", "why": "cast(NULL AS STRING)"}
    end = (
        "named_struct('valid', s.done AND s.why = '', 'position', IF(s.done, s.at, s.n - 1), 'reason', "
        "CASE WHEN s.done THEN s.why WHEN s.pending > 0 THEN 'stream ends mid-argument' ELSE 'missing EOS' END)"
    )
    bad = lambda why: f"named_struct('valid', false, 'position', 0, 'reason', '{why}')"
    fold = f"aggregate(slice({tokens}, 2, greatest({n} - 1, 0)), {struct(init)}, (s, t) -> {step}, s -> {end})"
    return f"CASE WHEN {n} = 0 THEN {bad('empty stream')} WHEN {tokens}[0] <> 1 THEN {bad('missing BOS')} ELSE {fold} END"


def is_valid(tokens: str) -> str:
    """validated(tokens).valid at less cost for a stream that is: the state is one number.

    0 stands for a boundary or what is after a shape, 1 for after a path's command, 2 for after a continuity token,
    10 and 20 and more for so many arguments to come of a path's command or of another group, -1 for a violation.
    """
    t, s = "t", "s"
    opened = {3: 0} | {k: 10 + n if n else 1 for k, n in COMMAND_ARGS.items()} | {k: 20 + n if n else 0 for k, n in (SHAPE_ARGS | SPATIAL_ARGS).items()}
    then = " ".join(f"WHEN {k} THEN {n}" for k, n in opened.items())
    step = (
        f"CASE WHEN {s} >= 10 THEN CASE WHEN {ids.is_coord(t)} THEN IF({s} % 10 > 1, {s} - 1, IF({s} < 20, 1, 0)) ELSE -1 END WHEN {s} < 0 THEN -1 "
        f"WHEN {s} = 1 AND {_is(t, 30, 34)} THEN 2 WHEN {s} > 0 AND {_is(t, 40, 56)} THEN 0 ELSE CASE {t} {then} ELSE -1 END END"
    )
    n = f"size({tokens})"
    fine = f"{n} > 1 AND get({tokens}, 0) = 1 AND get({tokens}, {n} - 1) = 2 AND aggregate(slice({tokens}, 2, greatest({n} - 2, 0)), 0, (s, t) -> {step}) BETWEEN 0 AND 2"
    return f"CASE WHEN {fine} THEN true ELSE ({validated(tokens)}).valid END"


def repaired(tokens: str) -> str:
    """The stream with what isn't allowed left out, cut back to its last complete group, and closed."""
    t = "t"

    def step(s: str) -> str:
        skip = f"({s}.stop OR {t} IN (1, 2) OR NOT ({allowed(t, s)}))"
        nxt = advance(t, s)
        state = {k: f"IF({skip}, {s}.{k}, {v})" for k, v in nxt.items()} | {
            # Tokens are held until no argument is pending; what is still held at the end is left out.
            "held": f"CASE WHEN {skip} THEN {s}.held WHEN ({nxt['pending']}) = 0 THEN {NONE} ELSE concat({s}.held, array({t})) END",
            "stop": f"{s}.stop OR {t} = 2",
        }
        return struct({"st": struct(state), "out": f"IF({skip} OR ({nxt['pending']}) > 0, {NONE}, concat({s}.held, array({t})))"})

    init = START | {"held": NONE, "stop": "false"}
    return f"concat(array(1), {scan(tokens, t, struct(init), 'struct<pending:int,state:int,path:boolean,held:array<int>,stop:boolean>', 'int', step)}, array(2))"


#: A state of each kind (pending, state, path): states of one kind admit the same ids.
KINDS = [(1, 1, "true"), (0, 2, "true"), (0, 3, "true"), (0, 0, "false")]


def kind(s: str = "s") -> str:
    """The place in KINDS of a state: an argument pending, after a path's command, after a continuity token, any other."""
    return f"CASE WHEN {s}.pending > 0 THEN 0 WHEN {s}.state = 2 AND {s}.path THEN 1 WHEN {s}.state = 3 THEN 2 ELSE 3 END"


def kinds() -> str:
    """The states of KINDS, as an array."""
    return "array(" + ", ".join(struct(dict(zip(START, map(str, k), strict=True))) for k in KINDS) + ")"


def reached(tokens: str) -> str:
    """The state after a prefix that begins with BOS."""
    return f"aggregate(slice({tokens}, 2, greatest(size({tokens}) - 1, 0)), {struct(START)}, (s, t) -> {struct(advance('t'))})"


def masked(state: str, size: int = ids.VOCAB) -> str:
    """Whether each id may follow in a state."""
    return f"element_at(transform(array({state}), s -> transform(sequence(0, {size - 1}), v -> {allowed('v')})), 1)"


def mask(tokens: str, size: int = ids.VOCAB) -> str:
    """Whether each id may follow a prefix that begins with BOS."""
    return masked(reached(tokens), size)
