"""A lexer for shell scripts: simple commands with their words, and what is left open.

Quotes, substitutions, subshells and blocks nest, so they are kept on a stack; nothing is run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: What opens and closes a block, where a command may begin.
BLOCKS = {"if": "fi", "do": "done", "case": "esac", "{": "}"}
#: Words after which a command may begin.
LEADS = frozenset(("if", "then", "else", "elif", "while", "until", "do", "!", "time", "{"))
PLACEHOLDER = re.compile(r"(?<!<)<[A-Za-z_][A-Za-z0-9_.-]*>")
PLAIN = re.compile(r"[^\s\\'\"`$();&|<>{}#]+")


@dataclass
class Frame:
    """A level of the script: what opened it, the blocks open in it, and the command that is being read."""

    opened: str
    blocks: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    word: str | None = None
    target: bool = False  # the next word is a redirection's
    leads: bool = True  # a command may begin


@dataclass
class Script:
    commands: list[list[str]] = field(default_factory=list)
    problem: str = ""


def read_script(text: str) -> Script:
    """The simple commands, those of substitutions and subshells included, in the order of their ends.

    problem: quote, block or bracket for what is open at the end or closed without being open, the first found; empty
    if there is none.  Words in <> stand for values.  Comments, redirections, bodies of here-documents and arithmetic
    are no words.  Whether a block has the parts it needs isn't looked at.
    """
    text = PLACEHOLDER.sub("PLACEHOLDER", text)
    out, stack, heredocs, at = Script(), [Frame("")], [], 0

    def wrong(what: str) -> None:
        out.problem = out.problem or what

    def end_word() -> None:
        top = stack[-1]
        if top.word is None:
            return
        word, top.word = top.word, None
        if top.target:
            top.target = False
        elif top.leads and word in BLOCKS:
            top.blocks.append(word)
            top.leads = word != "case"
        elif top.leads and word in BLOCKS.values():
            if not top.blocks or BLOCKS[top.blocks.pop()] != word:
                wrong("block")
            top.leads = False
        elif top.leads and word in LEADS:
            pass
        else:
            top.words.append(word)
            # an assignment may stand before the command; case's word is followed by `in`
            top.leads = bool(re.match(r"[A-Za-z_]\w*\+?=", word)) and len(top.words) == 1

    def end_command() -> None:
        end_word()
        top = stack[-1]
        if top.words:
            out.commands.append(top.words)
        top.words, top.leads, top.target = [], True, False

    def add(piece: str) -> None:
        stack[-1].word = (stack[-1].word or "") + piece

    def close(opened: str) -> None:
        """Ends the top frame, whose text is part of a word below."""
        end_command()
        if stack[-1].blocks:
            wrong("block")
        stack.pop()

    n = len(text)
    while at < n:
        top, c = stack[-1], text[at]
        quoted = top.opened == '"'
        if c == "\\" and at + 1 < n:
            if text[at + 1] != "\n":
                add(text[at + 1])
            at += 2
        elif text.startswith("$((", at) and (end := arithmetic_end(text, at + 1)):
            add("0")
            at = end
        elif text.startswith("$(", at):
            add("")
            stack.append(Frame("$("))
            at += 2
        elif text.startswith("${", at):
            end = text.find("}", at)
            if end < 0:
                wrong("bracket")
                end = n
            add(text[at : end + 1])
            at = end + 1
        elif c == "`":
            if top.opened == "`":
                close("`")
            elif any(f.opened == "`" for f in stack) and quoted is False:
                wrong("quote")
            else:
                add("")
                stack.append(Frame("`"))
            at += 1
        elif quoted:
            if c == '"':
                word = top.word or ""
                stack.pop()
                add(word)
                at += 1
            else:
                end = at + 1
                while end < n and text[end] not in '"\\`$':
                    end += 1
                add(text[at:end])
                at = end
        elif c == "'":
            end = text.find("'", at + 1)
            if end < 0:
                wrong("quote")
                end = n
            add(text[at + 1 : end])
            at = end + 1
        elif c == '"':
            stack.append(Frame('"'))
            at += 1
        elif c == "#" and top.word is None:
            end = text.find("\n", at)
            at = end if end >= 0 else n
        elif c == "\n":
            end_command()
            at += 1
            while heredocs:
                at = heredoc_end(text, at, *heredocs.pop(0))
        elif c in " \t\r\v\f":
            end_word()
            at += 1
        elif c in ";&|":
            end_command()
            at += 1
        elif c == "(":
            if text.startswith("((", at) and top.leads and top.word is None and (end := arithmetic_end(text, at)):
                at = end
                continue
            if top.word is not None and top.word.endswith("="):  # an array
                stack.append(Frame("=("))
            else:
                end_command()
                stack.append(Frame("("))
            at += 1
        elif c == ")":
            end_word()
            if top.blocks and top.blocks[-1] == "case":  # after a pattern
                top.words, top.leads = [], True
            elif top.opened in ("$(", "(", "=("):
                if top.opened == "=(":
                    top.words = []
                close(top.opened)
            else:
                end_command()
                wrong("bracket")
            at += 1
        elif c in "<>":
            if top.word is not None and top.word.isdigit():
                top.word = None
            end_word()
            if m := re.compile(r"<<(-?)(?!<)[ \t]*(\\?[^\s;&|<>()]+)").match(text, at):
                heredocs.append((re.sub(r"['\"\\]", "", m[2]), bool(m[1])))
                at = m.end()
            elif text[at + 1 : at + 2] == "(":  # a process's file
                stack.append(Frame("("))
                at += 2
            else:
                while at < n and text[at] in "<>&|":
                    at += 1
                top.target = True
        else:
            m = PLAIN.match(text, at)
            add(m[0] if m else c)
            at = m.end() if m else at + 1
    while len(stack) > 1:
        top = stack[-1]
        wrong("quote" if top.opened in ('"', "`") else "bracket")
        close(top.opened)
    end_command()
    if stack[0].blocks:
        wrong("block")
    return out


def arithmetic_end(text: str, at: int) -> int | None:
    """Where the arithmetic ends whose two brackets open at `at`; None if it isn't closed by two."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i + 1 if text[i - 1] == ")" else None
    return None


def heredoc_end(text: str, at: int, mark: str, tabs: bool) -> int:
    """Where the line after the here-document's mark begins; the text's end if it has none."""
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        at = end + 1
        if (line.lstrip("\t") if tabs else line) == mark:
            return at
    return len(text)
