"""Tables that parameterise the operators: rules, cues, fields, kinds of change."""
