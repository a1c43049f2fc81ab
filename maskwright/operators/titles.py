"""Forms of address before names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.patterns import SPACE
from maskwright.policy import HYBRID, Span

# Titles by language.
TITLES = {
    "en": "Mr|Mr.|Mister|Mrs|Mrs.|Missus|Ms|Ms.|Miss|Mx|Mx.|Dr|Dr.|Doctor|Prof|Prof.|Professor|Rev|Rev.|Reverend|Fr|Fr.|Father|Sr|Sr.|Sister|Br|Br.|Brother|Capt|Capt.|Captain|Col|Col.|Colonel|Gen|Gen.|General|Lt|Lt.|Lieutenant|Sgt|Sgt.|Sergeant|Maj|Maj.|Major|Cpl|Cpl.|Corporal|Pvt|Pvt.|Private|Adm|Adm.|Admiral|Cmdr|Cmdr.|Commander|Sir|Dame|Lord|Lady|Hon|Hon.|Honorable|The Honorable|Rt Hon|Rt. Hon.|Right Honorable|The Right Honorable|Esq|Esq.|Esquire|Atty|Atty.|Attorney|Judge|Justice",
    "de": "Herr|Frau|Fräulein|Dr|Dr.|Doktor|Prof|Prof.|Professor|Mag|Mag.|Magister|Dipl|Dipl.|Diplom|Dipl.-Ing|Dipl.-Ing.|Diplomingenieur|Ing|Ing.|Ingenieur|Dr. med|Dr. med.|Dr. jur|Dr. jur.|Dr. phil|Dr. phil.|Dr. rer. nat|Dr. rer. nat.|Dr. h.c|Dr. h.c.|Prof. Dr|Prof. Dr.|Gen|Gen.|General|Oberst|Major|Hauptmann|Pfarrer|Pastor|Bischof",
    "fr": "M|M.|Monsieur|Mme|Mme.|Madame|Mlle|Mlle.|Mademoiselle|Dr|Dr.|Docteur|Pr|Pr.|Professeur|Prof|Prof.|Me|Me.|Maître|Maitre|Mgr|Mgr.|Monseigneur|Gén|Gén.|Général|Gen|Gen.|Col|Col.|Colonel|Cdt|Cdt.|Commandant|Capt|Capt.|Capitaine|Lt|Lt.|Lieutenant|Père|Frère|Sœur|Soeur|Abbé",
    "es": "Sr|Sr.|Señor|Sra|Sra.|Señora|Srta|Srta.|Señorita|Don|Doña|D.|Dña.|Dr|Dr.|Doctor|Dra|Dra.|Doctora|Prof|Prof.|Profesor|Profa|Profa.|Profesora|Lic|Lic.|Licenciado|Licenciada|Ing|Ing.|Ingeniero|Ingeniera|Arq|Arq.|Arquitecto|Arquitecta|Abog|Abog.|Abogado|Abogada|Gral|Gral.|General|Cnel|Cnel.|Coronel|Cap|Cap.|Capitán|Tte|Tte.|Teniente|Padre|Fray|Sor",
    "it": "Sig|Sig.|Signor|Signore|Sig.ra|Signora|Sig.na|Signorina|Dott|Dott.|Dottore|Dottor|Dott.ssa|Dottoressa|Prof|Prof.|Professore|Professor|Prof.ssa|Professoressa|Ing|Ing.|Ingegnere|Avv|Avv.|Avvocato|Arch|Arch.|Architetto|Rag|Rag.|Ragioniere|Geom|Geom.|Geometra|Conte|Contessa|Marchese|Marchesa|Principe|Principessa|Duca|Duchessa|Don|Padre|Fra|Suor|Mons|Mons.|Monsignore",
    "pt": "Sr|Sr.|Senhor|Sra|Sra.|Senhora|Srta|Srta.|Senhorita|Dr|Dr.|Doutor|Dra|Dra.|Doutora|Prof|Prof.|Professor|Profa|Profa.|Professora|Eng|Eng.|Engenheiro|Engenheira|Arq|Arq.|Arquiteto|Arquiteta|Dom|Dona|Gen|Gen.|General|Cel|Cel.|Coronel|Cap|Cap.|Capitão|Ten|Ten.|Tenente|Padre|Frei|Irmã|Irmão",
    "nl": "Dhr|Dhr.|De heer|Meneer|Mijnheer|Mevr|Mevr.|Mevrouw|Mw|Mw.|Mejuffrouw|Juffrouw|Dr|Dr.|Doctor|Prof|Prof.|Professor|Ir|Ir.|Ingenieur|Mr|Mr.|Meester|Drs|Drs.|Doctorandus|Ing|Ing.|Gen|Gen.|Generaal|Kol|Kol.|Kolonel|Kapt|Kapt.|Kapitein|Ds|Ds.|Dominee|Pastoor|Pater",
    "lv": "kungs|kundze|jaunkundze|k-gs|k-dze|Dr|Dr.|doktors|Prof|Prof.|profesors",
    "ar": "السيد|السيدة|الآنسة|Al-Sayyid|As-Sayyid|Sayyid|Al-Sayyida|As-Sayyida|Sayyida|Al-Aanisa|Aanisa|الدكتور|الدكتورة|الأستاذ|الأستاذة|المهندس|المهندسة|Dr|Dr.|Doktor|Ustadh|Ustadha|Ustaaz|Muhandis|Muhandisa|الشيخ|Sheikh|Shaikh|Shaykh|الإمام|Imam|الحاج|Hajj|Hajji|Al-Hajj|أمير|Amir|Emir|سلطان|Sultan",
    "zh": "先生|女士|小姐|太太|博士|教授|医生|老师|老師|工程师|工程師|律师|律師|将军|將軍|上校|上尉|阁下|閣下|大人",
}


def titles(language: str | None = None) -> list[str]:
    """All titles, or those of a language, the longest first."""
    chosen = TITLES.values() if language is None else [TITLES.get(language, "")]
    return sorted({t for line in chosen for t in line.split("|") if t}, key=lambda t: (-len(t), t))


_SPACE1 = f"[{SPACE}]+"
_ANY = "|".join(re.escape(t) for t in titles())
_LEADING = re.compile(f"(?:{_ANY}){_SPACE1}(?=[^{SPACE}])", re.I)
_ONLY = re.compile(f"[{SPACE}]*(?:{_ANY})[{SPACE}]*", re.I)


def extract_title(name: str) -> tuple[str | None, str, int]:
    """(title, name without it, length of the title with the blanks behind it)."""
    m = _LEADING.match(name)
    return (m[0].strip(), name[m.end() :], m.end()) if m else (None, name, 0)


def starts_with_title(text: str) -> bool:
    return extract_title(text)[0] is not None


def only_title(text: str) -> bool:
    return bool(_ONLY.fullmatch(text))


def without_titles(spans: Sequence[Span]) -> list[Span]:
    """PERSON spans begun behind their title, which is kept as an attribute."""
    out = []
    for s in spans:
        title, rest, size = extract_title(s.text) if s.type == "PERSON" else (None, s.text, 0)
        out.append(replace(s, start=s.start + size, text=rest, title=title) if title else s)
    return out


def merge_title_spans(spans: Sequence[Span], text: str, most: int = 3) -> list[Span]:
    """A PERSON span that is only a title is joined with the PERSON span behind it, at most ``most`` blanks or signs away."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: s.start):
        last = out[-1] if out else None
        if last and last.type == s.type == "PERSON" and only_title(last.text) and 0 <= s.start - last.end <= most and re.fullmatch(r"[\W_]*", text[last.end : s.start]):
            source = last.source if last.source == s.source else HYBRID
            out[-1] = Span("PERSON", last.start, s.end, max(last.confidence, s.confidence), source, text[last.start : s.end])
        else:
            out.append(s)
    return out


def title_column(name: Column) -> Column:
    """The title that a name begins with, or null; all in the JVM."""
    return F.nullif(F.trim(F.regexp_extract(name, f"(?iu)^({_java()}){_SPACE1}(?=[^{SPACE}])", 1)), F.lit(""))


def name_column(name: Column) -> Column:
    return F.regexp_replace(name, f"(?iu)^(?:{_java()}){_SPACE1}(?=[^{SPACE}])", "")


def _java() -> str:
    return "|".join(re.sub(r"([.\-])", r"\\\1", t) for t in titles())
