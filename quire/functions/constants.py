"""Fixed values of the rewrites: tables that results depend on."""

#: LaTeX commands and the text they stand for.
SIGNS = {
    "times": "×", "cdot": "·", "ast": "∗", "star": "⋆", "odot": "⊙", "otimes": "⊗",
    "oplus": "⊕", "circ": "∘", "bullet": "•", "in": "∈", "notin": "∉", "ni": "∋",
    "subset": "⊂", "subseteq": "⊆", "supset": "⊃", "supseteq": "⊇", "cup": "∪", "cap": "∩",
    "emptyset": "∅", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "neq": "≠",
    "ne": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "propto": "∝", "pm": "±",
    "mp": "∓", "div": "÷", "infty": "∞", "partial": "∂", "nabla": "∇", "sum": "∑",
    "prod": "∏", "int": "∫", "sqrt": "√", "angle": "∠", "top": "ᵀ", "perp": "⊥",
    "forall": "∀", "exists": "∃", "neg": "¬", "wedge": "∧", "vee": "∨", "rightarrow": "→",
    "to": "→", "leftarrow": "←", "leftrightarrow": "↔", "Rightarrow": "⇒", "Leftarrow": "⇐", "Leftrightarrow": "⇔",
    "ldots": "…", "dots": "…", "cdots": "⋯", "ell": "ℓ", "quad": " ", "qquad": "  ",
    "epsilon": "ε", "varepsilon": "ε", "varphi": "φ", "alpha": "α", "beta": "β", "gamma": "γ",
    "delta": "δ", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ",
    "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ",
    "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ",
    "omega": "ω", "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ",
    "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}

#: LaTeX commands whose argument stands for itself.
WRAPPERS = (
    "mathbb", "mathcal", "mathbf", "mathrm", "mathit", "mathsf", "mathtt",
    "text", "textbf", "textit", "operatorname", "textnormal", "boldsymbol",
)

#: LaTeX accents and the combining characters they stand for.
ACCENTS = {
    "hat": "\u0302", "bar": "\u0304", "tilde": "\u0303", "vec": "\u20d7", "dot": "\u0307",
    "ddot": "\u0308", "check": "\u030c", "breve": "\u0306", "acute": "\u0301", "grave": "\u0300",
}

#: LaTeX commands that stand for their own names.
FUNCTIONS = {
    "Pr", "arccos", "arcsin", "arctan", "arg", "bmod", "cos", "cosh", "cot", "csc",
    "deg", "det", "diag", "dim", "exp", "gcd", "inf", "lg", "lim", "ln",
    "log", "max", "min", "mod", "rank", "relu", "sec", "sigmoid", "sin", "sinh",
    "softmax", "sup", "tan", "tanh", "tr",
}

#: Code ranges of raised and of lowered characters.
RAISED = ((0x00B2, 0x00B3), (0x00B9, 0x00B9), (0x02B0, 0x02FF), (0x1D2C, 0x1D61), (0x1D9C, 0x1DBF), (0x2070, 0x2071), (0x2074, 0x207F))
LOWERED = ((0x1D62, 0x1D6A), (0x2080, 0x209C))

#: Private-use characters of the Symbol font and the text they stand for.
SYMBOLS = {
    "\uf022": "∀", "\uf024": "∃", "\uf027": "∋", "\uf02a": "∗", "\uf02b": "+", "\uf02d": "−",
    "\uf03c": "<", "\uf03d": "=", "\uf03e": ">", "\uf041": "Α", "\uf042": "Β", "\uf043": "Γ",
    "\uf044": "Δ", "\uf045": "Ε", "\uf046": "Ζ", "\uf047": "Η", "\uf048": "Θ", "\uf049": "Ι",
    "\uf04a": "Κ", "\uf04b": "Λ", "\uf04c": "Μ", "\uf04d": "Ν", "\uf04e": "Ξ", "\uf04f": "Ο",
    "\uf050": "Π", "\uf051": "Ρ", "\uf052": "\u03a2", "\uf053": "Σ", "\uf054": "Τ", "\uf055": "Υ",
    "\uf056": "Φ", "\uf057": "Χ", "\uf058": "Ψ", "\uf059": "Ω", "\uf05a": "Ϊ", "\uf05c": "∴",
    "\uf05e": "⊥", "\uf061": "α", "\uf062": "β", "\uf063": "γ", "\uf064": "δ", "\uf065": "ε",
    "\uf066": "ζ", "\uf067": "η", "\uf068": "θ", "\uf069": "ι", "\uf06a": "κ", "\uf06b": "λ",
    "\uf06c": "μ", "\uf06d": "ν", "\uf06e": "ξ", "\uf06f": "ο", "\uf070": "π", "\uf071": "ρ",
    "\uf072": "ς", "\uf073": "σ", "\uf074": "τ", "\uf075": "υ", "\uf076": "φ", "\uf077": "χ",
    "\uf078": "ψ", "\uf079": "ω", "\uf07a": "ϊ", "\uf07e": "∼", "\uf0a2": "′", "\uf0a3": "≤",
    "\uf0a4": "⁄", "\uf0a5": "∞", "\uf0b0": "°", "\uf0b1": "±", "\uf0b2": "″", "\uf0b3": "≥",
    "\uf0b4": "×", "\uf0b5": "∝", "\uf0b6": "∂", "\uf0b7": "•", "\uf0b8": "÷", "\uf0b9": "≠",
    "\uf0ba": "≡", "\uf0bb": "≈", "\uf0bc": "…", "\uf0c4": "⊗", "\uf0c5": "⊕", "\uf0c6": "∅",
    "\uf0c7": "∩", "\uf0c8": "∪", "\uf0c9": "⊃", "\uf0ca": "⊇", "\uf0cc": "⊂", "\uf0cd": "⊆",
    "\uf0ce": "∈", "\uf0cf": "∉", "\uf0d0": "∠", "\uf0d1": "∇", "\uf0d5": "∏", "\uf0d6": "√",
    "\uf0d7": "⋅", "\uf0d8": "¬", "\uf0d9": "∧", "\uf0da": "∨", "\uf0db": "⇔", "\uf0dc": "⇐",
    "\uf0dd": "⇑", "\uf0de": "⇒", "\uf0df": "⇓", "\uf0e0": "◊", "\uf0e1": "⟨", "\uf0e5": "∑",
    "\uf0e6": "(", "\uf0e7": ")", "\uf0e8": "[", "\uf0e9": "]", "\uf0ea": "{", "\uf0eb": "}",
    "\uf0ec": "⟨", "\uf0ed": "⟩", "\uf0ee": "|", "\uf0f1": "⟩", "\uf0f2": "∫", "\uf0f3": "⌠",
    "\uf0f5": "⌡",
}

#: Punctuation that stands alone among CJK text.
CJK_MARKS = "，。；：？！“”‘’（）《》、—…·．,.;:?!()[]<>\"'/\\"
