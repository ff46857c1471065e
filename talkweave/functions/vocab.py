"""Fixed values of the dialogue model: tokens, thresholds, backchannel words."""

TRANSITIONS = ["[C.LISTEN]", "[C.SPEAK]", "[S.LISTEN.INTERRUPT]", "[S.LISTEN.NATURAL]", "[S.SPEAK]"]
STOP_SPEAKING = ["[S.LISTEN.INTERRUPT]", "[S.LISTEN.NATURAL]"]
INTERLOCUTOR = "<interlocutor>"
SILENCE = "<SIL>"
#: What recognisers hear in silence: of a simultaneous one in lower case, of one of whole utterances as it writes them; and the log-probability below which it is not believed.
HEARD_SIMULTANEOUS = ["thank you", "bye", "we'll be right back", "see you next time"]
HEARD_WHOLE = ["Thank you.", "Bye.", "We'll be right back.", "see you next time."]
UNSURE_LOGPROB = -0.3
SILENCE_S = 0.64

#: Time units in a second; thresholds in units.
UNITS = 10_000
PAUSE, SHORT_BACKCHANNEL, SMALL_OVERLAP = 320, 10_000, 500
#: Longest a word without an end of its own may last, in seconds.
LONGEST_WORD_S = 0.5

# Texts that are backchannels, in lower case without blanks and punctuation.
BACKCHANNELS = (
    "uhhuh yeah right oh ohyeah okay yes huh sure um huhuh really ohreally uh ohokay ohuhhuh no yep isee wellyeah "
    "umhum mmhmm hum ok mhm ah yea mm"
).split()

LABELS = ["T", "C", "P", "G", "BC", "IF", "IB"]
#: Mask ids of tokens in training rows: 0 is ignored, 1 is a response, transitions follow in order.
MASKS = {token: k + 2 for k, token in enumerate(TRANSITIONS)}
