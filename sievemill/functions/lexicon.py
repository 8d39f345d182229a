"""Patterns that decide results, in the order in which they are reported."""

# fixed values: signs of an outcome in a text of facts
OUTCOME_PATTERNS = {
    "explicit_court_outcome": r"\bthe (?:court|tribunal|judge) (?:held|found|concluded|determined|ordered|awarded|dismissed|allowed|granted|rejected|ruled|decided)\b",
    "claim_disposition": r"\b(?:claim|claims|appeal|application|counterclaim) (?:was|were|is|are|be) (?:dismissed|allowed|granted|rejected|struck out)\b",
    "liability_conclusion": r"\b(?:plaintiff|defendant|respondent|appellant) (?:was|is|were|are) (?:not )?liable\b",
    "award_or_order": r"\b(?:shall pay|awarded damages|damages (?:of|in the sum of)|judgment (?:for|against)|final order)\b",
    "credibility_finding": r"\b(?:truthful|reliable|evasive|unreliable|credible) witness\b|\b(?:accepted|rejected) (?:the )?(?:evidence|testimony)\b",
    "judgment_entered": r"\bjudg(?:e)?ment\b.{0,100}\b(?:entered|given|granted|in favou?r|against|liability|damages|rescinding|ordering)\b",
    "admitted_liability": r"\badmitted liability\b",
    "judicial_credibility": r"\b(?:court|tribunal|judge)\b.{0,80}\b(?:preferred|accepted|rejected|not satisfied|found)\b.{0,80}\b(?:evidence|testimony|witness|honest|credible|reliable)\b",
    "appeal_disposition": r"\bappeal\b.{0,60}\b(?:dismissed|allowed|upheld|rejected)\b|\bretrial was ordered\b",
    "costs_awarded": r"\bcosts were awarded\b",
    "evaluative_conclusion": r"\b(?:no|insufficient) evidence to support\b|\bfailed to (?:provide|adduce|establish|prove) evidence\b|\bevidence\b.{0,60}\bdid not support\b|\ballegations?\b.{0,40}\b(?:vague|imprecise|unsupported)\b|\bthe (?:court|tribunal|judge|master|registrar)\b.{0,100}\b(?:received|made|found|considered|preferred|accepted|rejected|ordered|granted|dismissed|allowed|concluded|determined)\b",
    "legal_or_credibility_conclusion": r"\b(?:is|are|was|were) (?:only )?(?:not )?entitled to\b|\bevidence\b.{0,50}\bmore credible\b|\b(?:not been|not being|was not|were not) honest\b|\b(?:demonstrated|showed|established)\b.{0,40}\bexaggerat\w*\b|\b(?:credible|credibility|dishonest|exaggeration)\b",
    "party_evaluation": r"\b(?:plaintiff|defendant|applicant|respondent)(?:'s)?\b.{0,80}\b(?:contentions? were inconsistent|equally responsible)\b|\b(?:contentions? were inconsistent|equally responsible)\b",
}

# fixed values: terms of criminal and immigration matters
CRIMINAL_TERMS = r"\b(?:criminal|conviction|convicted|sentence|sentencing|prosecution|prosecutor|bail|offence|offense|indictment|charge|trafficking|imprisonment|custodial|habeas corpus|non-refoulement|refugee|torture claim|immigration|deportation|removal order|persecution|criminal conviction|case stated)\b"

# fixed values: terms that evaluate rather than tell
STRICT_TERMS = r"\b(?:court|tribunal|judge|master|registrar|judg(?:e)?ment|appeal|held|ordered|dismissed|allowed|granted|rejected|ruled|decided|found|concluded|determined|liable|liability|entitled|credible|credibility|honest|dishonest|exaggerat\w*|unchallenged|no evidence|insufficient evidence|failed to prove|failed to establish|did not support|not enforceable|enforceable|binding|valid|invalid|satisfactory|unsatisfactory|struck out|set aside|summary judgment|default judgment|interlocutory judgment|consent order|costs order|leave to defend)\b"

# fixed values: signs of a defence
DEFENSE_FLAG = r"defen[cs]\w*|contributory|counterclaim\w*|exception|whether.*liable"

# fixed values: families of matters
FAMILY_PATTERNS = {
    "contract_performance": r"\b(contracts?|agreements?|breach(?:es|ed|ing)?|sale and purchase|s&p|specific performance|terminat\w*|repudiat\w*|condition precedent|requisitions?)\b",
    "debt_payment": r"\b(debts?|loans?|invoices?|unpaid|arrears|deposits?|cheques?|promissory|money due|sum due|rent arrears|payments?)\b",
    "property_possession": r"\b(propert\w*|land|premises|tenan\w*|leas\w*|landlords?|possess\w*|occupation|titles?|conveyanc\w*|licen[cs]\w*)\b",
    "tort_negligence_damage": r"\b(negligence|duty of care|torts?|accidents?|injur\w*|damag\w*|causation|nuisance|defamation|collisions?)\b",
    "employment_compensation": r"\b(labou?r|employment|employees?|employers?|wages?|severance|employee'?s compensation|work injur\w*|dismiss\w*)\b",
    "company_insolvency": r"\b(compan(?:y|ies)|companies ordinance|shareholders?|directors?|liquidat\w*|winding up|insolven\w*|creditors?|unfair prejudice|scheme of arrangement)\b",
    "procedure_appeal": r"\b(appeals?|leave|extension of time|set aside|strike out|security for costs|summary judgment|judicial review|case stated|interlocutory|jurisdiction\w*|procedural)\b",
    "criminal_procedure": r"\b(criminal|conviction|sentence|sentencing|prosecution|hksar|bail|offen[cs]\w*|charg\w*|trafficking|indict\w*)\b",
    "immigration_non_refoulement": r"\b(immigration|refugee\w*|torture claim|non-refoulement|deport\w*|removal order|screening decision)\b",
    "public_law_judicial_review": r"\b(judicial review|public law|administrative law|director of|commissioner|secretary for|tribunal|board|public officer|leave to apply for judicial review)\b",
    "trust_probate_family": r"\b(trusts?|estates?|probate|will|inheritance|matrimonial|divorc\w*|maintenance|famil\w*)\b",
}

# fixed values: what a text demands, besides what is counted
DEMAND_PATTERNS = {
    "evidence_and_burden_assessment": r"\b(evidence|witness\w*|credib\w*|proof|prov\w*|burden\w*|conflict\w*|contradict\w*|alleg\w*|testimony|experts?|documentary)\b",
    "defense_or_counterargument_check": r"\b(defen[cs]\w*|counterclaim\w*|set-?offs?|limitation\w*|estoppel|laches|mitigat\w*|contributory|waiv\w*|illegal\w*|jurisdictional objection\w*)\b",
    "remedy_discretion_check": r"\b(specific performance|injunction\w*|declar\w*|stay\w*|set aside|leave|extension\w*|security for costs|equitable|discretion\w*)\b",
}

# fixed values: steps that follow from demands, before and after the steps of the families
STEPS_BEFORE = [("long_fact_filtering", "material_fact_filtering"), ("procedural_threshold_check", "procedural_threshold")]
STEPS_AFTER = [
    ("precedent_or_analogy_handling", "precedent_or_analogy_check"),
    ("evidence_and_burden_assessment", "evidence_burden_assessment"),
    ("defense_or_counterargument_check", "defense_counterargument_check"),
    ("remedy_discretion_check", "remedy_discretion_check"),
    ("multi_issue_composition", "issue_composition"),
]
