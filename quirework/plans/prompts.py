"""Prompts, as message lists."""

from __future__ import annotations


def _ask(system: str, user: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def context(documents: list[dict]) -> str:
    """The documents as numbered blocks of a prompt."""
    return "\n\n".join(f"[{d.get('citation_id') or f'S{n}'}]\nTitle: {d.get('title') or 'unknown'}\nPage: {d.get('page') or 'unknown'}\nSection: {d.get('section_path') or 'unknown'}\nContent:\n{(d.get('text') or '').strip()}" for n, d in enumerate(documents, 1))


def hypothetical(question: str):
    return _ask("Write a short passage that could stand in a document that answers the question.", question)


def relevance(question: str, document: str):
    return _ask('Say whether the document helps to answer the question. Answer in JSON: {"binary_score": "yes" or "no", "reason": "..."}.', f"Question: {question}\n\nDocument:\n{document}")


def rewrite(question: str):
    return _ask('Rewrite the question so that a search finds better documents. Answer in JSON: {"rewritten_question": "..."}.', question)


def answer(question: str, documents: list[dict], feedback: str | None = None):
    extra = f"\n\nThe last answer was not grounded: {feedback}" if feedback else ""
    return _ask("Answer from the numbered context only and cite its numbers.", f"Context:\n{context(documents)}\n\nQuestion: {question}{extra}")


def groundedness(generation: str, documents: list[dict]):
    return _ask('Say whether the context supports the answer. Answer in JSON: {"binary_score": "yes" or "no", "reason": "..."}.', f"Context:\n{context(documents)}\n\nAnswer:\n{generation}")


def usefulness(question: str, generation: str):
    return _ask('Say whether the answer answers the question. Answer in JSON: {"binary_score": "yes" or "no", "reason": "..."}.', f"Question: {question}\n\nAnswer:\n{generation}")


def gate(domain: str, recent: str):
    return _ask(f'Say whether the last message needs a search in documents about {domain}. Answer in JSON: {{"needs_retrieval": true or false, "reason": "..."}}.', recent)


def summary(conversation: str, existing: str = ""):
    return _ask("Summarise the conversation for its next turns." + (f" So far: {existing}" if existing else ""), conversation)


def plan(brief: str):
    return _ask("Split the research brief into at most four topics, one on each line.", brief)


def queries(topic: str):
    return _ask("Write at most three search queries for the topic, one on each line.", topic)


def compress(topic: str, material: str):
    return _ask("Condense the material to notes on the topic and keep its sources.", f"Topic: {topic}\n\n{material}")


def report(brief: str, notes: str):
    return _ask("Write the final report from the notes.", f"Brief: {brief}\n\nNotes:\n{notes}")
